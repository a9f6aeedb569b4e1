"""Results as JSON rows, as text, and as the elements that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.functions.scalars import ulid
from lodestone.sources.graph import PropertyGraph


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an object, nulls kept; NaN and infinities become null."""
    clean = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
        clean.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def elements_of(graph: PropertyGraph, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) whose ids stand in the result's text columns: nodes as (id, labels, properties as JSON), edges as
    (id, label, src, dst, directed, properties as JSON); the ends of a named edge are among the nodes."""
    ids = None
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            own = df.select(c.alias("shown"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            own = df.select(F.explode(c).alias("shown"))
        else:
            continue
        own = own.where(F.col("shown").rlike("^[0-9A-HJKMNP-TV-Z]{26}$"))
        ids = own if ids is None else ids.union(own)
    ids = (ids if ids is not None else graph.empty("shown string")).distinct()

    def packed(props) -> F.Column:
        return F.to_json(F.struct(*[F.col(f"`{p}`") for p in props])) if props else F.lit("{}")

    edges, ends = graph.empty("id string, label string, src string, dst string, directed boolean, properties string"), graph.empty("shown string")
    for p in graph.edges:
        directed = F.col("directed") if p.directed is None else F.lit(p.directed)
        hit = p.df.withColumn("shown", ulid(F.col("id"))).join(ids, "shown", "left_semi")
        edges = edges.union(hit.select("shown", F.lit(p.label), ulid(F.col("src")), ulid(F.col("dst")), directed, packed(p.props)))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("shown"))
    wanted = ids.union(ends).distinct()
    nodes = graph.empty("id string, labels array<string>, properties string")
    for p in graph.nodes:
        hit = p.df.withColumn("shown", ulid(F.col("id"))).join(wanted, "shown", "left_semi")
        labels = F.array(*[F.lit(x) for x in sorted(p.labels)]).cast("array<string>")
        nodes = nodes.union(hit.select("shown", labels, packed(p.props)))
    return nodes, edges


def text_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a table of text."""
    got = df.limit(rows).collect()
    cells = [df.columns, *[["null" if v is None else str(v) for v in r] for r in got]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, wide)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells[1:])])
