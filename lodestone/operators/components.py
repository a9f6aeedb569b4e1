"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.shared import forget, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    ``edges`` has the columns ``src`` and ``dst`` of one orderable type (longs here); direction, repeats and
    self-loops don't matter. Returns ``node``, ``component``; a node without an edge to another one
    is not in the result. Null ends are left out.

    Alternates the large-star and small-star steps, each a grouped minimum (combined before the
    shuffle) joined back, so a node with very many neighbours is never gathered in one task, and the
    rounds grow with the logarithm of the component size. Every round is cut by a written table.
    """
    current = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    current = materialize(current, "components")
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        )
        after = materialize(small, "components")
        forget(current)
        current = after
        roots = current.select(F.col("b").alias("a")).distinct()
        open_ends = current.join(roots, "a", "left_semi").select("a").limit(1)
        twice = current.groupBy("a").count().where("count > 1").select("a").limit(1)
        if not open_ends.union(twice).head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )
