"""Sessions: statements over one graph, with transactions, writes and files."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestone.errors import ConstraintViolation, GraphError
from lodestone.functions.scalars import NULL, Val, family, ulid_value
from lodestone.plans import ast as A
from lodestone.plans.compiler import Compiler, needs_of
from lodestone.plans.parser import parse
from lodestone.shared import materialize
from lodestone.sources.csv import read_edges, read_nodes
from lodestone.sources.graph import EDGE_FIELDS, NODE_FIELDS, TAGGED, PropertyGraph, as_type, own_type, unify

TYPES = {"INTEGER": "int", "FLOAT": "float", "STRING": "string", "BOOLEAN": "bool"}


class GraphSession:
    """Runs statements over a graph. Each write makes a new snapshot and is whole or not at all; with a path the
    snapshot is saved there after each write outside a transaction and at commit. As a context manager it
    rolls back an open transaction at its end."""

    def __init__(self, graph: PropertyGraph, path: str | None = None):
        self.graph, self.spark, self.path, self.before = graph, graph.spark, path, None

    # -- reading ----------------------------------------------------------------------------------
    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The statement's rows as a DataFrame; reads stay lazy, writes have happened when it returns."""
        word = re.fullmatch(r"\s*(begin|commit|rollback)\s*;?\s*", text, re.I)
        if word:
            getattr(self, word[1].lower())()
            return self.rows([(word[1].upper(),)], "result string")
        stmt = parse(text)
        parts = stmt.parts if isinstance(stmt, A.Union) else [stmt]
        if all(isinstance(p, A.Query) for p in parts):
            return Compiler(self.graph, params).run(stmt)
        frames = [self.write(p, params or {}) if not isinstance(p, A.Query) else Compiler(self.graph, params).run(p) for p in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out if len(frames) == 1 or stmt.all else out.distinct()

    query_with_params = query
    query_df = query

    def query_pandas(self, text: str, params: dict[str, Any] | None = None):
        return self.query(text, params).toPandas()

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)

    def get_node(self, id: int | str) -> dict[str, Any] | None:
        """Labels and properties of one node, by its id or the text that shows it."""
        key = ulid_value(id) if isinstance(id, str) else id
        for p in self.graph.nodes:
            row = p.df.where(F.col("id") == key).head()
            if row:
                return {"id": key, "labels": sorted(p.labels)} | {k: plain(row[k], t) for k, t in p.props.items() if row[k] is not None}
        return None

    def get_edge(self, id: int | str) -> dict[str, Any] | None:
        key = ulid_value(id) if isinstance(id, str) else id
        for p in self.graph.edges:
            row = p.df.where(F.col("id") == key).head()
            if row:
                return {"id": key, "label": p.label, "src": row["src"], "dst": row["dst"]} | {k: plain(row[k], t) for k, t in p.props.items() if row[k] is not None}
        return None

    def node_count(self, label: str | None = None) -> int:
        return self.graph.count("nodes", label)

    def edge_count(self, label: str | None = None) -> int:
        return self.graph.count("edges", label)

    # -- transactions -----------------------------------------------------------------------------
    def begin(self) -> None:
        if self.before is not None:
            raise GraphError("transaction already active")
        self.before = self.graph

    def commit(self) -> None:
        if self.before is None:
            raise GraphError("no active transaction")
        self.before = None
        self.publish()

    def rollback(self) -> None:
        if self.before is None:
            raise GraphError("no active transaction")
        self.graph, self.before = self.before, None

    def __enter__(self) -> GraphSession:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        if self.before is not None:
            self.rollback()

    def publish(self) -> None:
        if self.path and self.before is None:
            from lodestone.sources.catalog import publish

            publish(self.graph, self.path)

    def clear(self) -> None:
        if self.before is not None:
            raise GraphError("TRUNCATE can't run in a transaction")
        self.graph = replace(self.graph, nodes=(), edges=(), csv_ids=None)
        self.publish()

    def load_csv_nodes(self, path: str, label: str | None = None) -> int:
        graph, n = read_nodes(self.graph, path, label)
        self.become(graph)
        return n

    def load_csv_edges(self, path: str, label: str | None = None) -> tuple[int, int]:
        graph, n, skipped = read_edges(self.graph, path, label)
        self.become(graph)
        return n, skipped

    def load_csv(self, nodes: str, edges: str) -> tuple[int, int, int]:
        return (self.load_csv_nodes(nodes), *self.load_csv_edges(edges))

    def become(self, graph: PropertyGraph) -> None:
        self.graph = graph
        self.publish()

    # -- writing ----------------------------------------------------------------------------------
    def result(self, verb: str, n: int) -> DataFrame:
        return self.rows([(f"{verb} {n} element(s)" + (" [txn]" if self.before is not None else ""),)], "result string")

    def write(self, stmt, params: dict[str, Any]) -> DataFrame:
        if isinstance(stmt, A.Insert):
            return self.insert(stmt, params)
        if isinstance(stmt, A.Update):
            return {"SET": self.set, "REMOVE": self.set, "DELETE": self.delete}[stmt.kind](stmt, params)
        return self.admin(stmt)

    def insert(self, stmt: A.Insert, params) -> DataFrame:
        """Rows of bindings (one row without MATCH or UNWIND) times the elements. A node with properties that is
        there already with at least these labels and properties is taken instead of a new one, and so is an edge
        of the same ends and label; nodes of UNWIND ... INSERT always are new."""
        compiler = Compiler(self.graph, params)
        frame, scope = None, {}
        if stmt.patterns:
            q = A.Query(patterns=stmt.patterns, where=stmt.where)
            compiler_needs = needs_of([q, stmt.elements])
            frame, scope = compiler.match(stmt.patterns, "WALK", None, {}, compiler_needs)
            if stmt.where is not None:
                frame = frame.where(compiler.expressions(scope, safe=True).condition(stmt.where))
        elif stmt.unwind:
            frame, scope = compiler.unwind(*stmt.unwind)
        else:
            frame = self.spark.range(1).select(F.lit(1).alias("__one"))
        if stmt.patterns or stmt.unwind:
            frame = frame.distinct() if stmt.patterns else frame
            frame = materialize(frame, "insert")
        graph, n = self.graph, 0
        ex = compiler.expressions(scope)
        ids = {v: s.id for v, s in scope.items() if s.kind == "node"}
        for p in stmt.elements:
            nodes = [p.start, *(x for _, x in p.steps)]
            for node in nodes:
                if node.var in ids and not (node.labels or node.props):
                    continue
                if node.var in ids and p.steps:
                    continue
                frame, graph, made = self.insert_node(node, frame, ex, graph, upsert=not stmt.unwind)
                ids[node.var or f"_{id(node)}"] = made[0]
                n += made[1]
            for (edge, to), frm in zip(p.steps, nodes):
                a, b = ids[frm.var or f"_{id(frm)}"], ids[to.var or f"_{id(to)}"]
                if edge.direction == "in":
                    a, b = b, a
                graph, made = self.insert_edge(edge, frame, a, b, ex, graph)
                n += made
        self.become(graph)
        return self.result("Inserted", n)

    def insert_node(self, node: A.NodePattern, frame: DataFrame, ex, graph: PropertyGraph, upsert: bool):
        labels = frozenset(node.labels)
        values = {k: self.storable(k, ex.value(v)) for k, v in node.props}
        name = f"__new_{len(frame.columns)}"
        rows = frame.count()
        if upsert and values:
            parts = graph.node_parts(sorted(labels))
            types = graph.prop_types(parts)
            if all(k in types or v.type == NULL for k, v in values.items()) and parts:
                from lodestone.functions.scalars import equal

                old, types = graph.scan_nodes(sorted(labels), set(values))
                old = old.select(F.col("id").alias("__old"), *[F.col(f"`{k}`").alias(f"__old_{k}") for k in values])
                same = F.lit(True)
                for k, v in values.items():
                    same = same & equal(Val(F.col(f"`__old_{k}`"), types[k]), v)
                tagged = materialize(frame.withColumn("__row", F.monotonically_increasing_id()), "insert")
                found = tagged.join(old, same).groupBy("__row").agg(F.min("__old").alias("__old"))
                frame = materialize(tagged.join(found, "__row", "left").drop("__row"), "insert")
            else:
                frame = frame.withColumn("__old", F.lit(None).cast("long"))
        else:
            frame = frame.withColumn("__old", F.lit(None).cast("long"))
        # rows of one statement that would make equal nodes with properties share one
        columns = {f"__v_{k}": v.col for k, v in values.items()}
        kinds = {k: T.StringType() if v.type == NULL else v.type for k, v in values.items()}
        work = frame.withColumns({c: v.cast(kinds[c[4:]]) for c, v in columns.items()}) if columns else frame
        base = graph.next_id
        if upsert and values and rows > 1:
            new = work.where("__old is null").select(*columns).distinct().withColumn("__id", F.monotonically_increasing_id() + F.lit(base))
            new = materialize(new, "insert")
            tie = [F.col(c).eqNullSafe(F.col(c + "_n")) for c in columns]
            condition = tie[0]
            for t in tie[1:]:
                condition = condition & t
            work = work.join(new.toDF(*[c + "_n" for c in columns], "__id"), condition & F.col("__old").isNull(), "left").drop(*[c + "_n" for c in columns])
            fresh = new
        elif rows > 1 or not isinstance(rows, int):
            work = materialize(work.withColumn("__id", F.monotonically_increasing_id() + F.lit(base)), "insert")
            fresh = work.where("__old is null")
        else:
            work = work.withColumn("__id", F.lit(base).cast("long"))
            fresh = work.where("__old is null")
        part = fresh.select(F.col("__id").cast("long").alias("id"), *[F.col(f"`{c}`").alias(c[4:]) for c in columns])
        made = part.count()
        if made:
            part = part if rows > 1 else self.local(part)
            self.check(graph, labels, part, {k: v for k, v in values.items()})
            top = part.agg(F.max("id")).head()[0]
            graph = replace(graph.with_nodes(labels, part), next_id=top + 1)
        frame = work.withColumn(name, F.coalesce("__old", "__id")).drop("__old", "__id", *columns)
        return frame, graph, (name, made)

    def local(self, df: DataFrame) -> DataFrame:
        """A table of a row or few as a local one."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def insert_edge(self, edge: A.EdgePattern, frame: DataFrame, a: str, b: str, ex, graph: PropertyGraph):
        values = {k: self.storable(k, ex.value(v)) for k, v in edge.props}
        directed = edge.direction != "any"
        kinds = {k: T.StringType() if v.type == NULL else v.type for k, v in values.items()}
        new = frame.select(F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst"), *[v.col.cast(kinds[k]).alias(k) for k, v in values.items()])
        new = new.dropDuplicates(["src", "dst"])
        if graph.edge_parts(edge.label):
            old = graph.adjacency(edge.label, "out")[0].select(F.col("node").alias("src"), F.col("nbr").alias("dst"))
            new = new.join(old, ["src", "dst"], "left_anti")
        new = new.select((F.monotonically_increasing_id() + F.lit(graph.next_id)).alias("id"), "src", "dst", F.lit(directed).alias("directed"), *values)
        new = materialize(new, "insert") if frame.count() > 1 else self.local(new)
        made = new.count()
        if made:
            top = new.agg(F.max("id")).head()[0]
            graph = replace(graph.with_edges(edge.label, new, directed), next_id=top + 1)
        return graph, made

    @staticmethod
    def storable(key: str, v: Val) -> Val:
        if isinstance(v.value, str) and "\0" in v.value:
            raise GraphError(f"property {key}: a string can't hold a NUL byte")
        if isinstance(v.type, (T.MapType, T.StructType)) and v.type != TAGGED:
            raise GraphError(f"property {key}: maps can't be stored")
        return v

    def check(self, graph: PropertyGraph, labels: frozenset[str], rows: DataFrame, values: dict[str, Val] | None = None) -> None:
        """Constraints of these labels for ``rows`` that are about to be stored (id and properties)."""
        props = {f.name: own_type(f.dataType) for f in rows.schema.fields}
        for kind, label, prop in graph.constraints:
            if label not in labels or prop not in props:
                continue
            if kind == "UNIQUE":
                twice = rows.where(F.col(f"`{prop}`").isNotNull()).groupBy(f"`{prop}`").count().where("count > 1")
                old, types = graph.scan_nodes([label], {prop})
                if types[prop] == NULL:
                    clash = False
                else:
                    both = unify([types[prop], props[prop]])
                    own = rows.select(F.col("id").alias("i"), as_type(F.col(f"`{prop}`"), props[prop], both).alias("v"))
                    have = old.select("id", as_type(F.col(f"`{prop}`"), types[prop], both).alias("v"))
                    clash = not own.join(have, "v").where("i <> id").join(rows.select("id"), "id", "left_anti").isEmpty()
                if clash or not twice.isEmpty():
                    raise ConstraintViolation(f"UNIQUE constraint on :{label}({prop})")
            else:
                got = values[prop].type if values and prop in values else props[prop]
                if family(got) not in (TYPES[kind], "null") and not rows.where(F.col(f"`{prop}`").isNotNull()).isEmpty():
                    raise ConstraintViolation(f"TYPE constraint on :{label}({prop}): not {kind}")

    def hits(self, stmt: A.Update, params):
        compiler = Compiler(self.graph, params)
        needs = needs_of(stmt)
        frame, scope = compiler.match(stmt.patterns, "WALK", None, {}, needs)
        if stmt.where is not None:
            frame = frame.where(compiler.expressions(scope, safe=True).condition(stmt.where))
        return frame, scope, compiler

    def set(self, stmt: A.Update, params) -> DataFrame:
        """SET and REMOVE: a table of (id, new values) joined to the parts that hold such an element."""
        frame, scope, compiler = self.hits(stmt, params)
        ex = compiler.expressions(scope)
        graph, n = self.graph, 0
        for var in dict.fromkeys([v for v, *_ in stmt.props] + [v for v, _ in stmt.labels]):
            if var not in scope or scope[var].kind not in ("node", "edge"):
                raise GraphError(f"{var} is not a node or edge of the pattern")
            sets = {p: self.storable(p, Val(F.lit(None), NULL) if stmt.kind == "REMOVE" else ex.value(e)) for v, p, e in stmt.props if v == var}
            labels = {x for v, x in stmt.labels if v == var}
            kinds = {p: T.StringType() if v.type == NULL else v.type for p, v in sets.items()}
            cols = [v.col.cast(kinds[p]).alias(f"__s_{p}") for p, v in sets.items()]
            hit = frame.select(F.col(f"`{scope[var].id}`").alias("id"), *cols).dropDuplicates(["id"])
            hit = materialize(hit, "set")
            n += hit.count() * (len(sets) + len(labels))
            node = scope[var].kind == "node"
            if not node and labels:
                raise GraphError("an edge has exactly one label")
            parts = []
            base = graph
            for p in graph.nodes if node else graph.edges:
                own = p.df.join(hit, "id", "left_semi")
                if own.isEmpty():
                    parts.append(p)
                    continue
                df = self.assign(p.df, p.props, hit, sets, kinds)
                new_labels = frozenset(p.labels | labels if stmt.kind == "SET" else p.labels - labels) if node else None
                if node:
                    changed = df.join(hit.select("id"), "id", "left_semi")
                    if sets and stmt.kind == "SET":
                        self.check(base, p.labels, changed.select("id", *sets), sets)
                    if new_labels != p.labels:
                        parts.append(replace(p, df=materialize(df.join(hit.select("id"), "id", "left_anti"), "set")))
                        parts.append(replace(p, labels=new_labels, df=materialize(changed, "set")))
                        continue
                parts.append(replace(p, df=materialize(df, "set")))
            if node:
                graph = replace(graph, nodes=())
                for p in parts:
                    graph = graph.with_nodes(p.labels, p.df)
            else:
                graph = replace(graph, edges=tuple(parts))
        self.become(graph)
        return self.result("Set" if stmt.kind == "SET" else "Removed", n)

    @staticmethod
    def assign(df: DataFrame, props, hit: DataFrame, sets, kinds) -> DataFrame:
        if not sets:
            return df
        fixed = [c for c in df.columns if c in (*NODE_FIELDS, *EDGE_FIELDS) and c not in props]
        joined = df.join(hit.withColumn("__hit", F.lit(True)), "id", "left")
        out = [F.col(c) for c in fixed]
        for p in dict.fromkeys([*props, *sets]):
            if p not in sets:
                out.append(F.col(f"`{p}`"))
                continue
            own = props.get(p, T.NullType())
            to = own if sets[p].type == NULL and p in props else unify([own, kinds[p]])
            old = as_type(F.col(f"`{p}`"), own, to) if p in props else F.lit(None).cast(to)
            out.append(F.when(F.col("__hit"), as_type(F.col(f"`__s_{p}`"), kinds[p], to).cast(to)).otherwise(old).alias(p))
        return joined.select(*out)

    def delete(self, stmt: A.Update, params) -> DataFrame:
        frame, scope, _ = self.hits(stmt, params)
        nodes, edges = None, None
        for var in stmt.variables:
            if var not in scope or scope[var].kind not in ("node", "edge"):
                raise GraphError(f"{var} is not a node or edge of the pattern")
            ids = frame.select(F.col(f"`{scope[var].id}`").alias("id"))
            if scope[var].kind == "node":
                nodes = ids if nodes is None else nodes.union(ids)
            else:
                edges = ids if edges is None else edges.union(ids)
        graph, n = self.graph, 0
        if edges is not None:
            edges = materialize(edges.distinct(), "delete")
            n += edges.count()
            graph = replace(graph, edges=tuple(without(p, edges, "id") for p in graph.edges))
        if nodes is not None:
            nodes = materialize(nodes.distinct(), "delete")
            n += nodes.count()
            ends = [nodes.withColumnRenamed("id", end) for end in ("src", "dst")]
            if not stmt.detach:
                for p in graph.edges:
                    if any(not p.df.join(e, e.columns[0], "left_semi").isEmpty() for e in ends):
                        raise GraphError("node has edges; use DETACH DELETE")
            else:
                graph = replace(graph, edges=tuple(without(without(p, ends[0], "src"), ends[1], "dst") for p in graph.edges))
            graph = replace(graph, nodes=tuple(without(p, nodes, "id") for p in graph.nodes))
        self.become(graph)
        return self.result("Deleted", n)

    # -- definitions ------------------------------------------------------------------------------
    def admin(self, s: A.Admin) -> DataFrame:
        said = lambda text: self.rows([(text,)], "result string")
        g = self.graph
        if s.kind == "TRUNCATE":
            self.clear()
            return self.rows([(True,)], "cleared boolean")
        if s.kind == "CREATE INDEX":
            if (s.label, s.prop) not in g.indexes:
                self.become(replace(g, indexes=(*g.indexes, (s.label, s.prop))))
            return said(f"Created index on :{s.label}({s.prop})")
        if s.kind == "DROP INDEX":
            if (s.label, s.prop) not in g.indexes:
                raise GraphError(f"no index on :{s.label}({s.prop})")
            self.become(replace(g, indexes=tuple(x for x in g.indexes if x != (s.label, s.prop))))
            return said(f"Dropped index on :{s.label}({s.prop})")
        if s.kind == "SHOW INDEXES":
            if not g.indexes:
                return said("No indexes defined.")
            return self.rows([self.index_row(label, prop) for label, prop in sorted(g.indexes)], "label string, property string, target string, entries long")
        if s.kind in ("CREATE CONSTRAINT", "DROP CONSTRAINT"):
            entry = (s.extra, s.label, s.prop)
            if s.kind == "CREATE CONSTRAINT":
                self.become(replace(g, constraints=(*(c for c in g.constraints if c != entry), entry)))
            elif entry not in g.constraints:
                raise GraphError(f"no such constraint on :{s.label}({s.prop})")
            else:
                self.become(replace(g, constraints=tuple(c for c in g.constraints if c != entry)))
            return said(f"{'Created' if s.kind[0] == 'C' else 'Dropped'} constraint on :{s.label}({s.prop})")
        if s.kind == "SHOW CONSTRAINTS":
            if not g.constraints:
                return said("No constraints defined.")
            return self.rows([(label, prop, "UNIQUE" if kind == "UNIQUE" else f"TYPE IS {kind}") for kind, label, prop in sorted(g.constraints)], "label string, property string, kind string")
        if s.kind == "LOAD NODES":
            return said(f"loaded {self.load_csv_nodes(s.extra, s.label)} nodes")
        n, skipped = self.load_csv_edges(s.extra, s.label)
        return said(f"loaded {n} edges" + (f" ({skipped} skipped: unknown ends)" if skipped else ""))

    def index_row(self, label: str, prop: str) -> tuple:
        node = label in self.graph.node_labels() or label not in self.graph.edge_labels()
        parts = self.graph.node_parts([label]) if node else self.graph.edge_parts(label)
        own = [p for p in parts if prop in p.props and not isinstance(p.props[prop], T.ArrayType)]
        return (label, prop, "node" if node else "edge", sum(p.df.where(F.col(f"`{prop}`").isNotNull()).count() for p in own))


def without(part, gone: DataFrame, on: str):
    """``part`` without the rows whose ``on`` is in ``gone``; written anew only if it has such rows."""
    if part.df.join(gone, on, "left_semi").isEmpty():
        return part
    return replace(part, df=materialize(part.df.join(gone, on, "left_anti").select(part.df.columns), "delete"))


def plain(value: Any, t: T.DataType) -> Any:
    return value[value["t"]] if t == TAGGED else value


def empty_graph(spark: SparkSession) -> GraphSession:
    return GraphSession(PropertyGraph(spark))
