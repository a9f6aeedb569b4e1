"""Positions and running sums within large groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.shared import materialize

#: Rows of a bucket in an order, and buckets at most.
EACH, MOST = 50_000, 10_000
WORD = r"[^\x20\x09-\x0D]+"


def seeded(key: str | Column, seed: int) -> Column:
    """A shuffle key for ``key`` that depends on the seed only: 32 hex digits, equal in any SQL engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def stratum(source: str) -> Column:
    """``source`` as a key without nulls; a null source is a stratum of its own, after the others."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def dealt(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` written in buckets that follow each other in ``order``, the bucket in ``_bucket``. All of ``order`` tells buckets
    apart: neither a hot group nor many rows with one key stay together, only rows equal in all of it."""
    buckets = max(1, min(MOST, -(-rows // EACH)))
    return materialize(df.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id()), "ranked")


def ranked(df: DataFrame, group: str, key: str, ties: list[str], rows: int, size: str | None = None) -> DataFrame:
    """Add ``rank`` (from 1) and, given ``size``, ``before`` (sizes of those ahead) in the order of
    ``key``, ``ties`` within each ``group``.

    Rows are dealt into buckets by ranges of (group, key, ties); a count per (group, bucket), combined
    before its shuffle, gives each bucket's offset, and rows are ordered within their bucket only. So a
    group with most of all rows spreads over as many tasks as it has buckets, and so do rows with one key."""
    df = dealt(df, [group, key, *ties], rows)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(size).alias("_s")] if size else [])
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(group, "_bucket").agg(*sums)
    offsets = offsets.select(
        group,
        "_bucket",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0")] if size else []),
    )
    within = Window.partitionBy(group, "_bucket").orderBy(key, *ties)
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("rank", F.row_number().over(within))
    if size:
        out = out.withColumn("before", F.coalesce(F.sum(size).over(running), F.lit(0)))
    out = out.join(offsets, [group, "_bucket"])
    out = out.withColumn("rank", F.col("rank") + F.col("_n0"))
    if size:
        out = out.withColumn("before", F.col("before") + F.col("_s0"))
    return out.drop("_bucket", "_n0", "_s0")
