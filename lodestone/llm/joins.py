"""Joins to tables with one row for each key, however often a key is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows at most that a caller may call heavy.
HEAVY = 50_000


def lookup(rows: DataFrame, table: DataFrame, on: str, heavy: Column) -> DataFrame:
    """``rows`` joined (inner) to the row of ``table`` with the same ``on``, which is unique there.

    ``heavy`` tells the rows of ``table`` that many rows may ask for. The caller sees to it that they are
    HEAVY at most, as a threshold on a count that sums to a known total does; they are broadcast, and
    only the others go through a shuffle by key, where no key has more than total / HEAVY rows."""
    hot, cold = table.where(heavy), table.where(~heavy)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
