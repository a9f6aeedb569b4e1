"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestone.llm.ranking import dealt, ranked, seeded, stratum
from lodestone.shared import materialize

SHARDS, SEED = 16, 20240229


def interleave_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Shard and slot of every row: ``id_col``, the ``keep`` columns, ``stratum``, ``position``, ``shard``, ``slot``.

    Rows are shuffled by seed within their source and get the fractional rank (rank - 1/2) / rows of the
    source. All rows sorted by it form one sequence in which each stretch has the sources in proportion;
    it is cut into ``shards`` runs whose counts differ by one at most (law ``rows``). ``slot`` counts
    from 0 without gaps within a shard.

    Both orders are found from counts per bucket (see :func:`ranked`), so neither a hot source nor the
    whole sequence passes through one task, nor do many sources of one row, which all have the rank 1/2. Defined cases: a null source is a stratum of its own; a null
    id is shuffled as an empty string; repeated rows each get a slot, and rows equal in all kept columns
    may swap places; a source of one row gets rank 1/2; with fewer rows than shards some shards are
    empty; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    keep = keep or {}
    narrow = docs.select(
        F.col(id_col), *[c.alias(k) for k, c in keep.items()], stratum(source_col).alias("stratum"), seeded(id_col, seed).alias("_key")
    )
    narrow = materialize(narrow, "shard-rows")
    rows = narrow.count()
    if not rows:
        return narrow.drop("_key").select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("position", "long"), ("shard", "int"), ("slot", "long"))])
    ties = [id_col, *keep]
    total = narrow.groupBy("stratum").agg(F.count(F.lit(1)).alias("_of"))
    mixed = ranked(narrow, "stratum", "_key", ties, rows).join(total, "stratum")
    mixed = mixed.withColumn("_f", (F.col("rank") - F.lit(0.5)) / F.col("_of"))
    order = ["_f", "stratum", "_key", *ties]
    mixed = dealt(mixed, order, rows)
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mixed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # a row for each bucket
    offsets = offsets.select("_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"))
    out = mixed.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))).join(offsets, "_bucket")
    position = F.col("_n0") + F.col("_at") - 1
    shard = F.expr(f"position * {shards} div {rows}")
    return (
        out.withColumn("position", position)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * cast({rows} as bigint) + {shards - 1}) div {shards}"))
        .select(id_col, *keep, "stratum", "position", "shard", "slot")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keep = {"size": (F.octet_length(text) + F.lit(1)).cast("long"), "text_crc32": F.crc32(text)}
    return interleave_shards(docs, keep=keep).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: DuckDB has no CRC-32. It is taken by its table over pieces of 256 bytes (the first of a text is shorter);
#: the state moves over a later piece by XOR of the piece's own remainder and the state moved over 256 zero bytes.
SQL_OP5 = f"""
WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(0, 256) r(i))),
    zero AS (SELECT list(v ORDER BY j, i) AS z FROM (SELECT j, i, list_reduce(list_prepend((i << (8 * j))::BIGINT, range(0, 256)),
        lambda c, k: xor(c >> 8, t[(c & 255) + 1])) AS v FROM range(0, 256) r(i), range(0, 4) q(j), tbl)),
    raw AS (SELECT row_number() OVER () AS i, doc_id, source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    piece AS (SELECT i, j, CASE WHEN j = 0 THEN substr(hx, 1, 2 * (length(hx) // 2 % 256)) ELSE substr(hx, (2 * (length(hx) // 2 % 256) + 512 * (j - 1) + 1)::BIGINT, 512) END AS h
        FROM (SELECT i, hx, unnest(range(0, length(hx) // 512 + 1)) AS j FROM raw)),
    part AS (SELECT i, j, list_reduce(list_prepend(CASE WHEN j = 0 THEN 4294967295::BIGINT ELSE 0::BIGINT END,
        list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::BIGINT, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS v FROM piece, tbl),
    whole AS (SELECT i, list_reduce(l, lambda c, v: xor(xor(xor(z[(c & 255) + 1], z[((c >> 8) & 255) + 257]),
        xor(z[((c >> 16) & 255) + 513], z[((c >> 24) & 255) + 769])), v)) AS s FROM (SELECT i, list(v ORDER BY j) AS l FROM part GROUP BY i), zero),
    crc AS (SELECT doc_id, source, length(hx) // 2 + 1 AS size, xor(4294967295::BIGINT, s) AS text_crc32 FROM raw JOIN whole USING (i)),
    keyed AS (SELECT doc_id, size, text_crc32, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM crc),
    f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, size, text_crc32) - 0.5::DOUBLE)
        / count(*) OVER (PARTITION BY stratum) AS f FROM keyed),
    p AS (SELECT *, row_number() OVER (ORDER BY f, stratum, k, doc_id, size, text_crc32) - 1 AS position,
        count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {SHARDS} // n)::INTEGER AS shard,
    position - ((position * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM p
"""

QUERIES = {"op5_sharding": op5_sharding}
ORACLES = {"op5_sharding": SQL_OP5}
