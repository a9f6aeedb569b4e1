"""Nodes and edges from CSV files with ``:ID``, ``:LABEL``, ``:START_ID``, ``:END_ID`` and ``:TYPE`` columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.errors import GraphError
from lodestone.shared import materialize
from lodestone.sources.graph import PropertyGraph, tagged


def read_strings(graph: PropertyGraph, path: str) -> DataFrame:
    df = graph.spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    return df.toDF(*[c.strip() for c in df.columns])


def cell_kind(c: Column) -> Column:
    """0 boolean, 1 integer, 2 float, 3 string; null for an empty cell (no property)."""
    return (
        F.when(c.isNull() | (c == ""), F.lit(None))
        .when(F.lower(c).isin("true", "false"), 0)
        .when(c.rlike(r"^[+-]?\d+$") & c.try_cast("long").isNotNull(), 1)
        .when(c.try_cast("double").isNotNull() & ~c.rlike("[dDfF]$"), 2)
        .otherwise(3)
    )


def typed(df: DataFrame, props: list[str]) -> list[Column]:
    """Columns with the one type that all their cells have; integers and floats make floats, other mixtures the
    tagged type, which keeps each cell's own."""
    if not props:
        return []
    kinds = df.agg(*[F.collect_set(cell_kind(F.col(f"`{p}`"))).alias(p) for p in props]).head().asDict()
    out = []
    for p in props:
        c, found = F.col(f"`{p}`"), set(kinds[p])
        c = F.when(c != "", c)
        if found == {0}:
            c = c.cast("boolean")
        elif found == {1}:
            c = c.cast("long")
        elif found and found <= {1, 2}:
            c = c.cast("double")
        elif len(found) > 1:
            own = cell_kind(c)
            c = F.when(own == 0, tagged(c.try_cast("boolean"), T.BooleanType())).when(own == 1, tagged(c.try_cast("long"), T.LongType())).when(
                own == 2, tagged(c.try_cast("double"), T.DoubleType())).otherwise(tagged(c, T.StringType()))
        out.append(c.alias(p))
    return out


def read_nodes(graph: PropertyGraph, path: str, label: str | None = None) -> tuple[PropertyGraph, int]:
    """A node for each row; the label is the row's ``:LABEL``, else ``label``. Other columns that start with a
    colon are ignored. A repeated ``:ID`` is an error."""
    df = read_strings(graph, path)
    if ":ID" not in df.columns:
        raise GraphError("the file has no :ID column")
    df = materialize(df.withColumn("__id", F.monotonically_increasing_id() + F.lit(graph.next_id)), "csv")
    own = df.select(F.col("`:ID`").alias("csv_id"), F.col("__id").alias("id"))
    ids = own if graph.csv_ids is None else graph.csv_ids.union(own)
    if not ids.groupBy("csv_id").count().where("count > 1").isEmpty():
        raise GraphError("duplicate :ID")
    props = [c for c in df.columns if c[:1] != ":" and c != "__id"]
    columns = typed(df, props)
    kind = F.coalesce(F.when(F.col("`:LABEL`") != "", F.col("`:LABEL`")), F.lit(label)) if ":LABEL" in df.columns else F.lit(label)
    df = df.withColumn("__label", kind.cast("string"))
    for (name,) in df.select("__label").distinct().collect():
        rows = df.where(F.col("__label").eqNullSafe(F.lit(name))).select(F.col("__id").alias("id"), *columns)
        graph = graph.with_nodes(frozenset([name] if name else []), rows)
    top = df.agg(F.max("__id")).head()[0]
    return replace(graph, next_id=(top or graph.next_id) + 1, csv_ids=ids), df.count()


def read_edges(graph: PropertyGraph, path: str, label: str | None = None) -> tuple[PropertyGraph, int, int]:
    """A directed edge for each row whose ends are known ids; returns the graph, edges made and rows skipped. The
    label is the row's ``:TYPE``, else ``label``, else RELATED."""
    df = read_strings(graph, path)
    for need in (":START_ID", ":END_ID"):
        if need not in df.columns:
            raise GraphError(f"the file has no {need} column")
    rows = df.count()
    ids = graph.csv_ids if graph.csv_ids is not None else graph.empty("csv_id string, id long")
    kind = F.coalesce(F.when(F.col("`:TYPE`") != "", F.col("`:TYPE`")), F.lit(label or "RELATED")) if ":TYPE" in df.columns else F.lit(label or "RELATED")
    props = [c for c in df.columns if c[:1] != ":"]
    columns = typed(df, props)
    df = df.select(kind.alias("__label"), F.col("`:START_ID`").alias("__s"), F.col("`:END_ID`").alias("__e"), *columns)
    df = df.join(ids.toDF("__s", "src"), "__s").join(ids.toDF("__e", "dst"), "__e")
    df = materialize(df.withColumn("id", F.monotonically_increasing_id() + F.lit(graph.next_id)), "csv")
    made = df.count()
    for (name,) in df.select("__label").distinct().collect():
        part = df.where(F.col("__label") == name).select("id", "src", "dst", F.lit(True).alias("directed"), *[F.col(f"`{p}`") for p in props])
        graph = graph.with_edges(name, part)
    top = df.agg(F.max("id")).head()[0]
    return replace(graph, next_id=(top or graph.next_id) + 1), made, rows - made


__all__ = ["read_edges", "read_nodes"]
