"""Property graphs as tables: nodes by their set of labels, edges by their label."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestone.errors import GraphError
from lodestone.shared import materialize

NODE_FIELDS, EDGE_FIELDS = ("id",), ("id", "src", "dst", "directed")


@dataclass(frozen=True)
class NodePart:
    """Nodes with exactly these labels; ``df``: id and one typed column for each property."""

    labels: frozenset[str]
    df: DataFrame

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: own_type(f.dataType) for f in self.df.schema.fields if f.name not in NODE_FIELDS}


@dataclass(frozen=True)
class EdgePart:
    """Edges of one label; ``df``: id, src, dst, directed and the properties. ``directed``: True or False if
    all edges are, None if that varies."""

    label: str
    df: DataFrame
    directed: bool | None = True

    @property
    def props(self) -> dict[str, T.DataType]:
        return {f.name: own_type(f.dataType) for f in self.df.schema.fields if f.name not in EDGE_FIELDS}


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def is_int(t) -> bool:
    return isinstance(t, INTEGERS)


def is_float(t) -> bool:
    return isinstance(t, FLOATS)


def display(c: Column, t: T.DataType) -> Column:
    """The value's text; a float that is whole loses its ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "") if is_float(t) else c.cast("string")


#: A property that holds values of several kinds: which one (``t``), and the value in its own field. Groups, joins and
#: compares by kind and value.
TAGGED = T.StructType(
    [T.StructField("t", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())]
)


def own_type(t: T.DataType) -> T.DataType:
    """TAGGED where ``t`` is that but for which fields may be null."""
    return TAGGED if t.simpleString() == TAGGED.simpleString() else t


def unify(types: list[T.DataType]) -> T.DataType:
    """One type for a property that has several: the same, a number wide enough, or the tagged one."""
    kinds = {t.simpleString(): t for t in types if not isinstance(t, T.NullType)}
    if not kinds:
        return T.StringType()
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(is_int(t) for t in kinds.values()):
        return T.LongType()
    if all(is_int(t) or is_float(t) for t in kinds.values()):
        return T.DoubleType()
    if any(isinstance(t, T.ArrayType) for t in kinds.values()):
        return T.StringType()
    return TAGGED


def tagged(c: Column, own: T.DataType) -> Column:
    """The value in the tagged form; types other than the four go in as text."""
    if own == TAGGED:
        return c
    tag = "b" if isinstance(own, T.BooleanType) else "i" if is_int(own) else "d" if is_float(own) else "s"
    fields = [F.lit(tag).alias("t")]
    fields += [(c if f.name == tag else F.lit(None)).cast(f.dataType).alias(f.name) for f in TAGGED.fields[1:]]
    return F.when(c.isNotNull(), F.struct(*fields)) if not isinstance(own, T.NullType) else F.lit(None).cast(TAGGED)


def tagged_text(c: Column) -> Column:
    return F.coalesce(c["s"], c["i"].cast("string"), display(c["d"], T.DoubleType()), c["b"].cast("string"))


def as_type(c: Column, own: T.DataType, to: T.DataType) -> Column:
    if own == to:
        return c
    if to == TAGGED:
        return tagged(c, own)
    if own == TAGGED:
        return tagged_text(c) if isinstance(to, T.StringType) else F.coalesce(c["d"], c["i"].cast("double")).cast(to)
    return display(c, own) if isinstance(to, T.StringType) and not isinstance(own, T.NullType) else c.cast(to)


def stack(frames: list[tuple[DataFrame, dict[str, Column]]], columns: dict[str, T.DataType]) -> DataFrame:
    """Union of frames over ``columns``; a column that a frame lacks is null there."""
    out = None
    for df, extra in frames:
        have = {f.name: own_type(f.dataType) for f in df.schema.fields}
        cols = []
        for name, to in columns.items():
            if name in extra:
                c = extra[name].cast(to)
            elif name in have:
                c = as_type(F.col(f"`{name}`"), have[name], to)
            else:
                c = F.lit(None).cast(to)
            cols.append(c.alias(name))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable snapshot; a write makes another one. Scans read only the parts with the labels asked for
    and only the columns asked for."""

    spark: SparkSession
    nodes: tuple[NodePart, ...] = ()
    edges: tuple[EdgePart, ...] = ()
    next_id: int = 1
    indexes: tuple[tuple[str, str], ...] = ()
    constraints: tuple[tuple[str, str, str], ...] = ()  # kind, label, property
    csv_ids: DataFrame | None = field(default=None, compare=False)

    # -- schema -----------------------------------------------------------------------------------
    def node_labels(self) -> set[str]:
        return {x for p in self.nodes for x in p.labels}

    def edge_labels(self) -> set[str]:
        return {p.label for p in self.edges}

    def node_parts(self, labels: list[str]) -> list[NodePart]:
        return [p for p in self.nodes if set(labels) <= p.labels]

    def edge_parts(self, label: str | None) -> list[EdgePart]:
        return [p for p in self.edges if label in (None, p.label)]

    def prop_types(self, parts) -> dict[str, T.DataType]:
        found: dict[str, list] = {}
        for p in parts:
            for name, t in p.props.items():
                found.setdefault(name, []).append(t)
        return {name: unify(types) for name, types in found.items()}

    # -- scans ------------------------------------------------------------------------------------
    def empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def scan_nodes(self, labels: list[str], props: set[str], with_labels: bool = False, with_keys: bool = False) -> tuple[DataFrame, dict[str, T.DataType]]:
        """id, the ``props``, and on request ``__labels`` and ``__keys`` (property names, sorted)."""
        parts = self.node_parts(labels)
        types = {k: t for k, t in self.prop_types(parts).items() if k in props}
        types |= {k: T.NullType() for k in props if k not in types}
        columns = {"id": T.LongType()} | types
        strings = T.ArrayType(T.StringType())
        columns |= ({"__labels": strings} if with_labels else {}) | ({"__keys": strings} if with_keys else {})
        frames = []
        for p in parts:
            extra = {"__labels": F.array(*[F.lit(x) for x in sorted(p.labels)]) if p.labels else F.array().cast("array<string>")} if with_labels else {}
            if with_keys:
                extra["__keys"] = keys_of(p.props)
            frames.append((p.df, extra))
        if not frames:
            frames = [(self.empty("id long"), {k: F.lit(None) for k in ("__labels", "__keys") if k in columns})]
        return stack(frames, columns), types

    def scan_edges(self, label: str | None, props: set[str], with_label: bool = False, with_keys: bool = False) -> tuple[DataFrame, dict[str, T.DataType]]:
        parts = self.edge_parts(label)
        types = {k: t for k, t in self.prop_types(parts).items() if k in props}
        types |= {k: T.NullType() for k in props if k not in types}
        columns = {"id": T.LongType(), "src": T.LongType(), "dst": T.LongType(), "directed": T.BooleanType()} | types
        columns |= ({"__label": T.StringType()} if with_label else {}) | ({"__keys": T.ArrayType(T.StringType())} if with_keys else {})
        frames = []
        for p in parts:
            extra = {"__label": F.lit(p.label)} if with_label else {}
            if p.directed is not None:
                extra["directed"] = F.lit(p.directed)
            if with_keys:
                extra["__keys"] = keys_of(p.props)
            frames.append((p.df, extra))
        if not frames:
            frames = [(self.empty("id long, src long, dst long, directed boolean"), {k: F.lit(None) for k in ("__label", "__keys") if k in columns})]
        return stack(frames, columns), types

    def adjacency(self, label: str | None, direction: str, props: set[str] = frozenset(), with_label: bool = False, with_keys: bool = False):
        """(``node``, ``nbr``, ``eid``, properties) of each way an edge can be walked from ``node``.

        An undirected edge is walked both ways under ``out`` and ``in``; an undirected self-loop twice. With
        ``any``, an edge shows once from each end, a self-loop once."""
        edges, types = self.scan_edges(label, props, with_label, with_keys)
        rest = [F.col(f"`{c}`") for c in edges.columns if c not in ("id", "src", "dst", "directed")]
        forth = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.col("id").alias("eid"), *rest)
        back = edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("id").alias("eid"), *rest)
        if direction == "any":
            out = forth.union(edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.col("id").alias("eid"), *rest))
            return out, types
        main, other = (forth, back) if direction == "out" else (back, forth)
        if all(p.directed for p in self.edge_parts(label)):
            return main, types
        loose = edges.where("not directed")
        a, b = ("dst", "src") if direction == "out" else ("src", "dst")
        return main.union(loose.select(F.col(a).alias("node"), F.col(b).alias("nbr"), F.col("id").alias("eid"), *rest)), types

    # -- writes -----------------------------------------------------------------------------------
    def with_nodes(self, labels: frozenset[str], df: DataFrame) -> PropertyGraph:
        """Another part with nodes of these labels (joined to a part that is there already)."""
        return replace(self, nodes=_put(self.nodes, NodePart(labels, df), lambda p: p.labels == labels))

    def with_edges(self, label: str, df: DataFrame, directed: bool | None = True) -> PropertyGraph:
        return replace(self, edges=_put(self.edges, EdgePart(label, df, directed), lambda p: p.label == label))

    def count(self, what: str = "nodes", label: str | None = None) -> int:
        parts = self.node_parts([label] if label else []) if what == "nodes" else self.edge_parts(label)
        return sum(p.df.count() for p in parts)

    # -- files ------------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        """A folder of Parquet tables with a manifest of them; the manifest is written last."""
        meta = {"next_id": self.next_id, "indexes": self.indexes, "constraints": self.constraints, "csv_ids": self.csv_ids is not None, "nodes": [], "edges": []}
        if self.csv_ids is not None:
            self.csv_ids.write.mode("overwrite").parquet(f"{path}/csv-ids")
        for kind, parts in (("nodes", self.nodes), ("edges", self.edges)):
            for i, p in enumerate(parts):
                p.df.write.mode("overwrite").parquet(f"{path}/{kind}-{i}")
                own = {"labels": sorted(p.labels)} if kind == "nodes" else {"label": p.label, "directed": p.directed}
                meta[kind].append(own | {"path": f"{kind}-{i}", "schema": p.df.schema.json()})
        self.spark.createDataFrame([(json.dumps(meta),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        meta = json.loads(spark.read.text(f"{path}/manifest").head()[0])
        read = lambda p: spark.read.schema(T.StructType.fromJson(json.loads(p["schema"]))).parquet(f"{path}/{p['path']}")
        return PropertyGraph(
            spark,
            tuple(NodePart(frozenset(p["labels"]), read(p)) for p in meta["nodes"]),
            tuple(EdgePart(p["label"], read(p), p["directed"]) for p in meta["edges"]),
            meta["next_id"],
            tuple(map(tuple, meta["indexes"])),
            tuple(map(tuple, meta["constraints"])),
            spark.read.schema("csv_id string, id long").parquet(f"{path}/csv-ids") if meta.get("csv_ids") else None,
        )


def keys_of(props: dict[str, T.DataType]) -> Column:
    if not props:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.col(f"`{k}`").isNotNull(), F.lit(k)) for k in sorted(props)]))


def _put(parts: tuple, new, same) -> tuple:
    out, done = [], False
    for p in parts:
        if same(p):
            fields = NODE_FIELDS if isinstance(p, NodePart) else EDGE_FIELDS
            types = {f: T.BooleanType() if f == "directed" else T.LongType() for f in fields}
            both = [p, new]
            names = list(dict.fromkeys([*p.props, *new.props]))
            types |= {k: unify([x.props[k] for x in both if k in x.props]) for k in names}
            if isinstance(p, NodePart):
                out.append(replace(p, df=stack([(x.df, {}) for x in both], types)))
            else:
                flags = [{} if x.directed is None else {"directed": F.lit(x.directed)} for x in both]
                out.append(replace(p, df=stack([(x.df, f) for x, f in zip(both, flags)], types), directed=p.directed if p.directed == new.directed else None))
            done = True
        else:
            out.append(p)
    return tuple(out if done else [*out, new])


class GraphBuilder:
    """Maps tables to a graph: each node table has a label and a key column; ids are numbered by table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.nodes, self.edges, self.ordinals = spark, [], [], {}

    def node_table(self, label: str, df: DataFrame, key: str, ordinal: int | None = None, extra_labels: tuple[str, ...] = ()) -> GraphBuilder:
        """Nodes from the rows of ``df``; all columns are properties. Keys are integers from 0 to 2^40 - 1."""
        self.ordinals[label] = ordinal or len(self.ordinals) + 1
        props = [c for c in df.columns if c not in NODE_FIELDS]
        self.nodes.append(NodePart(frozenset((label, *extra_labels)), df.select(self.node_id(label, F.col(key)).alias("id"), *props)))
        return self

    def node_id(self, label: str, key: Column) -> Column:
        if label not in self.ordinals:
            raise GraphError(f"no node table {label}")
        return key.cast("long") + F.lit(self.ordinals[label] << 40)

    def edge_table(self, label: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], props: list[str] | None = None, directed: bool = True) -> GraphBuilder:
        """Edges from the rows of ``df``; ``src`` and ``dst`` are (node label, key column). Edge ids number the
        rows as they are read. A shuffle may deal rows anew at each reading, so a table that needs one is written once."""
        ordinal = 1 << 62 | (len(self.edges) + 1) << 52
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            df = materialize(df, "edges")
        self.edges.append(
            EdgePart(
                label,
                df.select(
                    (F.monotonically_increasing_id() + F.lit(ordinal)).alias("id"),
                    self.node_id(src[0], F.col(src[1])).alias("src"),
                    self.node_id(dst[0], F.col(dst[1])).alias("dst"),
                    F.lit(directed).alias("directed"),
                    *(props or []),
                ),
                directed,
            )
        )
        return self

    def build(self) -> PropertyGraph:
        edges: tuple = ()
        for part in self.edges:
            edges = _put(edges, part, lambda p, part=part: p.label == part.label)
        return PropertyGraph(self.spark, tuple(self.nodes), edges, 1 << 61)


__all__ = ["EdgePart", "GraphBuilder", "NodePart", "PropertyGraph", "materialize"]
