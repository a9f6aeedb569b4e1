"""URL rules through a blocked Bloom filter and an exact hash join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Bits set in a block of 64, and entries for each block: under 1 % of foreign keys pass.
BITS, PER_BLOCK = 5, 6
#: Rows of a table that are broadcast at most; a larger one is joined by its key.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_host(url: str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def canonical_path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))


def _mask(key: str) -> Column:
    """One word with up to BITS bits set, from a hash other than the block's."""
    h = F.xxhash64(F.col(key), F.lit("bits"))
    bits = [F.expr("shiftleft(1L, {})".format("cast(_h >> %d & 63 as int)" % (6 * i))) for i in range(BITS)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return h, mask


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """(``block``, ``word``): a blocked Bloom filter with one 64-bit word for each block that is in use.
    A key touches one block only, so a look-up is one probe of a hash join."""
    h, mask = _mask("key")
    return entries.select(_block("key", blocks).alias("block"), h.alias("_h")).select("block", mask.alias("_m")).groupBy("block").agg(F.bit_or("_m").alias("word"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` (``host``, ``path``, ``verdict``) lists canonical URL prefixes. A rule fits its host and all
    subdomains where the URL's path starts with the rule's (compared as they are, so an empty path fits
    no rule that starts with ``/``); the longest fitting rule decides (host and path together, then the
    host). Where none fits, the URL isn't listed: ``rule`` is null and the verdict is ``default``.

    Each distinct (host, path) is turned into the keys that a listed rule could have: suffixes of the
    host with as many labels as some rule has, times prefixes of the path as long as some rule's. Keys
    probe the blocked Bloom filter; those that pass go to a hash join with the rules themselves, which
    removes false positives. Filter and rules are broadcast while they hold at most ``BROADCAST_ROWS``
    rows, and joined by key beyond that.

    Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule of a
    non-empty host; repeated rows each get the verdict; of two rules with the same host and path the
    verdict ``block`` holds; rules with a null host or path are ignored; empty tables give no rows or
    the default; input columns named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("rverdict"))
    rules = rules.groupBy("rhost", "rpath").agg(F.max("rverdict").alias("rverdict"))  # "block" is after "allow"
    rules = rules.withColumn("key", F.concat_ws("\n", "rhost", "rpath"))
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("rhost", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rpath"))).alias("lengths"),
    ).head()
    entries = shape["n"]
    blocks = max(1, -(-entries // PER_BLOCK))
    filled = bloom_filter(rules, blocks)
    if entries <= BROADCAST_ROWS:
        filled, rules = F.broadcast(filled), F.broadcast(rules)

    drop = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    judged = pages.withColumns({"_host": canonical_host(url_col), "_path": canonical_path(url_col)}).drop(*drop)
    if not entries:
        return judged.select("*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).drop("_host", "_path")
    hosts = F.array(*[F.when(F.size(F.split("_host", r"\.")) >= k, F.substring_index("_host", ".", -k)) for k in shape["labels"]])
    paths = F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in shape["lengths"]])
    keys = judged.select("_host", "_path").distinct()
    keys = keys.select("_host", "_path", F.explode(F.array_compact(hosts)).alias("h"), paths.alias("p"))
    keys = keys.select("_host", "_path", "h", F.explode(F.array_compact("p")).alias("p")).withColumn("key", F.concat_ws("\n", "h", "p"))
    h, mask = _mask("key")
    maybe = keys.withColumns({"block": _block("key", blocks), "_h": h}).withColumn("_m", mask)
    maybe = maybe.join(filled, "block").where(F.col("word").bitwiseAND(F.col("_m")) == F.col("_m"))
    hits = maybe.join(rules, "key").groupBy("_host", "_path").agg(
        F.max(F.struct((F.length("rhost") + F.length("rpath")).alias("len"), F.length("rhost").alias("hlen"), "rhost", "rpath", "rverdict")).alias("best")
    )
    out = judged.join(hits, ["_host", "_path"], "left")
    return out.select(
        *[c for c in judged.columns if c not in ("_host", "_path")],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.concat("best.rhost", "best.rpath").alias("rule"),
        F.coalesce("best.rverdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL_OP3 = r"""
WITH rules(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    p AS (SELECT row_number() OVER () AS i, page_id,
        translate(coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)', 2, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(.*?)://[^/?#]*([^?#]*)', 2, 's'), '') AS path FROM pages),
    m AS (SELECT i, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC) AS k
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (i)
"""

QUERIES = {"op3_url_filters": op3_url_filters}
ORACLES = {"op3_url_filters": SQL_OP3}
