"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm.joins import fresh
from lodestone.llm.ranking import WORD, ranked, seeded, stratum
from lodestone.shared import materialize

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 7411


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``target`` for each row of (``stratum``, ``source_size``, ``weight``).

    ``share`` times all sizes is dealt out by weight; a source stops at ``epochs`` times its size and the
    excess goes to the others by weight, until none is above. The result of that repetition is the
    water level L with sum(min(cap, L * weight)) = share * size: with the sources in the order of
    cap / weight, those before some place are full, and L follows from the sums behind it: it rises up to
    that place and falls after it, so it is the highest among those that agree with their own place. If all caps together hold less than the share, all are full. One row per source, so one small ordered window.
    """
    ratio = Window.orderBy("_ratio", "stratum")
    ahead, behind = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sources.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    out = out.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    out = out.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
    # the level if all sources ahead of this one are full and neither this one nor those behind it are
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind)
    out = out.withColumn("_level", level)
    out = out.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
    fill = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return out.select("stratum", "source_size", "weight", fill.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words that the mix takes of every row: ``id_col``, ``carry`` columns, ``size``, ``source_size``, ``target``,
    ``taken``, ``repeats`` and ``part``.

    Sources in the order of code points, null last, weigh ``weights`` repeating; :func:`water_fill` gives
    their targets. Of a source, each row is taken floor(target / source_size) whole times; the rest goes,
    in a seeded order, to whole further repetitions (``repeats``) until one row is left for which only
    some words remain: it is taken for that fraction (``part``: its leading words). So the words taken of
    a source are its target rounded to a word, and no row exceeds ``epochs`` times its size. With
    ``whole`` that one row is rounded to a whole repetition or none, and the text stays whole.

    Running sums come from sums per bucket (see :func:`ranked`); a hot source is never in one task.
    Defined cases: null text and text without words have size 0 and take 0 (a source of such rows has
    the target 0); null source is a source of its own, the last; repeated rows count each, and rows equal
    in id and size may swap; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(
        F.col(id_col),
        *carry,
        _words(text_col).alias("size"),
        stratum(source_col).alias("stratum"),
        seeded(id_col, seed).alias("_key"),
    )
    narrow = materialize(narrow, "mix-rows")
    sources = narrow.groupBy("stratum").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("stratum")) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    targets = water_fill(sources.withColumn("weight", weight), share, epochs)
    targets = targets.withColumn("_times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", F.round("target").cast("long") - F.col("_times") * F.col("source_size"))
    out = ranked(narrow, "stratum", "_key", [id_col, "size", *carry], narrow.count(), "size").join(targets, "stratum")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before")))
    if whole:
        more = F.when(more * 2 >= F.col("size"), F.col("size")).otherwise(0)
    out = out.withColumn("_more", more.cast("long")).withColumn("taken", F.col("_times") * F.col("size") + F.col("_more"))
    full = (F.col("_more") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        id_col, *carry, "size", "source_size", "target", "taken",
        (F.col("_times") + full.cast("long")).alias("repeats"),
        F.when(full, F.lit(0)).otherwise(F.col("_more")).alias("part"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """``docs`` as the mix takes it: each row as many times as its repetitions, texts whole, columns as they are.

    In the seeded order of a source, the rows up to some place are taken once more than those behind it.
    So a row for each source says all: the whole repetitions, and that last place (key, id and size).
    It is joined to the documents where they are read (broadcast up to 200,000 sources, by key beyond),
    and no text is shuffled or copied. Rows equal in id and size at that very place are all taken alike,
    which can move the words of a source with such repeated rows. Rows that the mix takes no words of (with
    size 0 among them) are left out.
    """
    order = lambda key: F.struct(key.alias("k"), F.col(id_col).alias("i"), _words(text_col).alias("s"))
    times = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, whole=True, carry=(source_col,), **options)
    times = times.withColumns({"_stratum": stratum(source_col), "_whole": F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")})
    more = (F.col("repeats") > F.col("_whole")) & (F.col("size") > 0)
    place = F.struct(seeded(id_col, seed).alias("k"), F.col(id_col).alias("i"), F.col("size").alias("s"))
    cuts = times.groupBy("_stratum").agg(F.max("_whole").alias("_whole"), F.max(F.when(more, place)).alias("_cut"))
    cuts = materialize(cuts, "mix-cuts")
    few = cuts.count() <= 200_000
    own, place, times = fresh(docs, "_stratum"), fresh(docs, "_place"), fresh(docs, "_times")
    whole, cut = fresh(docs, "_whole"), fresh(docs, "_cut")
    cuts = cuts.select(F.col("_stratum").alias(own), F.col("_whole").alias(whole), F.col("_cut").alias(cut))
    if few:
        cuts = F.broadcast(cuts)
    out = docs.withColumns({own: stratum(source_col), place: order(seeded(id_col, seed))}).join(cuts, own)
    extra = F.coalesce(F.col(place) <= F.col(cut), F.lit(False)).cast("int")
    repeats = F.when(F.col(place).s > 0, F.col(whole).cast("int") + extra).otherwise(0)
    out = out.withColumn(times, repeats).where(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def _words(text_col: str):
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL_OP7 = rf"""
WITH keyed AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS stratum,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
    s AS (SELECT stratum, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY stratum) - 1) % 3) + 1] AS w
        FROM keyed GROUP BY stratum),
    r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
    l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY cap / w, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lev FROM r),
    m AS (SELECT *, max(CASE WHEN lev <= cap / w THEN lev END) OVER () AS lv FROM l),
    t AS (SELECT stratum, source_size, least(cap, coalesce(lv * w, cap)) AS target FROM m),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
    d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed)
SELECT doc_id, size, source_size, target, (times * size
    + greatest(0, least(size, round(target)::BIGINT - times * source_size - ahead)))::BIGINT AS taken
FROM d JOIN b USING (stratum)
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": SQL_OP7}
