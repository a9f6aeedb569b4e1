"""Statements to DataFrames: patterns become joins, expressions columns, RETURN a select or an aggregate."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, fields, is_dataclass
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.errors import GraphError
from lodestone.functions.scalars import (
    AGGREGATES, ID, IDS, NULL, Val, arithmetic, array, compare, equal, family, is_string, literal, scalar, shown,
)
from lodestone.plans import ast as A
from lodestone.shared import materialize
from lodestone.sources.graph import TAGGED, PropertyGraph, is_float, is_int

#: Hops up to which a bounded path is one lazy plan; longer and unbounded paths run hop by hop.
LAZY_HOPS = 8
WALK_CAP = 25
#: Column with the number of rows that one row stands for.
TIMES = "__times"


@dataclass
class Sym:
    """What a variable stands for, and the columns that hold it."""

    kind: str  # node, edge, path, value
    id: str = ""
    type: Any = None  # of a value
    props: dict[str, tuple[str, Any]] = field(default_factory=dict)
    labels: str = ""
    keys: str = ""

    def columns(self) -> list[str]:
        return [self.id, *[c for c, _ in self.props.values()], *([self.labels] if self.labels else []), *([self.keys] if self.keys else [])]

    def renamed(self, f) -> Sym:
        return Sym(self.kind, f(self.id), self.type, {k: (f(c), t) for k, (c, t) in self.props.items()}, self.labels and f(self.labels), self.keys and f(self.keys))


def walk(x):
    """All expression and pattern nodes below ``x``."""
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))


def needs_of(stmt) -> dict[str, set[str]]:
    """For each variable the properties that the statement reads; ``:labels`` and ``:keys`` for those functions."""
    out: dict[str, set[str]] = defaultdict(set)
    renames = []
    for x in walk(stmt):
        if isinstance(x, A.Prop):
            out[x.var].add(x.name)
        elif isinstance(x, A.Call) and x.name in ("labels", "type", "keys") and x.args and isinstance(x.args[0], A.Var):
            out[x.args[0].name].add(":keys" if x.name == "keys" else ":labels")
        elif isinstance(x, (A.NodePattern, A.EdgePattern)) and x.var:
            out[x.var] |= {k for k, _ in x.props}
        elif isinstance(x, A.Item) and isinstance(x.expr, A.Var) and x.alias:
            renames.append((x.expr.name, x.alias))
    for old, new in renames:
        out[old] |= out[new]
    return out


def has_aggregate(x) -> bool:
    return any(isinstance(y, A.Call) and (y.name in AGGREGATES or y.star) for y in walk(x))


def label_of(x, source: str) -> str:
    """Column name of an item without alias: ``n.name``, ``count(*)``, ``f(...)``, else its source text."""
    if isinstance(x, A.Prop):
        return f"{x.var}.{x.name}"
    if isinstance(x, A.Var):
        return x.name
    if isinstance(x, A.Call):
        inner = "*" if x.star else ", ".join(label_of(a, "") for a in x.args)
        return f"{x.name}({'DISTINCT ' if x.distinct else ''}{inner})"
    if isinstance(x, A.Param):
        return f"${x.name}"
    if isinstance(x, A.Lit) and not source:
        return {None: "null", True: "true", False: "false"}.get(x.value, str(x.value)) if not isinstance(x.value, str) else f'"{x.value}"'
    return source.strip() or "expr"


class Expressions:
    """Compiles expressions in a scope. ``safe``: what would be an error is null (WHERE drops such rows)."""

    def __init__(self, scope: dict[str, Sym], params: dict[str, Any], safe: bool = False, known: dict | None = None):
        self.scope, self.params, self.safe, self.known = scope, params, safe, known or {}

    def value(self, x) -> Val:
        if self.known and x in self.known:
            return self.known[x]
        if isinstance(x, A.Lit):
            return literal(x.value)
        if isinstance(x, A.Param):
            return literal(self.params.get(x.name))
        if isinstance(x, A.ListExpr):
            return array([self.value(i) for i in x.items])
        if isinstance(x, A.Var):
            return self.variable(x.name)
        if isinstance(x, A.Prop):
            return self.prop(x)
        if isinstance(x, A.Not):
            v = self.value(x.arg)
            return Val(~v.col if family(v.type) == "bool" else F.lit(None).cast("boolean"), T.BooleanType())
        if isinstance(x, A.IsNull):
            c = self.value(x.arg).col.isNull()
            return Val(~c if x.negated else c, T.BooleanType())
        if isinstance(x, A.Bin):
            return self.binary(x)
        if isinstance(x, A.Call):
            return self.call(x)
        raise GraphError(f"not an expression: {x!r}")

    def variable(self, name: str) -> Val:
        s = self.scope.get(name)
        if s is None:
            return Val(F.lit(None), NULL)
        return Val(F.col(f"`{s.id}`"), {"node": ID, "edge": ID, "path": IDS}.get(s.kind, s.type))

    def prop(self, x: A.Prop) -> Val:
        s = self.scope.get(x.var)
        if s is None:
            return Val(F.lit(None), NULL)
        if s.kind == "value":
            if isinstance(s.type, T.StructType) and s.type != TAGGED and x.name in s.type.fieldNames():
                return Val(F.col(f"`{s.id}`").getField(x.name), s.type[x.name].dataType)
            return Val(F.lit(None), NULL)
        column, t = s.props.get(x.name, (None, NULL))
        if column is None:
            return Val(F.lit(None), NULL)
        return Val(F.col(f"`{column}`"), T.ArrayType(t) if s.kind == "path" else t)

    def binary(self, x: A.Bin) -> Val:
        flag, a, b = T.BooleanType(), self.value(x.left), self.value(x.right)
        if x.op in ("AND", "OR"):
            sides = [v.col.eqNullSafe(F.lit(True)) if family(v.type) == "bool" else F.lit(False) for v in (a, b)]
            return Val(sides[0] & sides[1] if x.op == "AND" else sides[0] | sides[1], flag)
        if x.op == "=":
            return Val(equal(a, b), flag)
        if x.op == "<>":
            return Val(~equal(a, b), flag)
        if x.op == "IN":
            if family(b.type) != "list":
                if self.safe:
                    return Val(F.lit(None).cast("boolean"), flag)
                raise GraphError("IN needs a list on its right")
            if b.type == IDS:
                return Val(F.exists(b.col, lambda e: equal(Val(e, ID), a)), flag)
            if isinstance(x.right, (A.ListExpr, A.Param)):  # one comparison for each element keeps literals' types
                items = [self.value(i) for i in x.right.items] if isinstance(x.right, A.ListExpr) else [literal(i) for i in self.params.get(x.right.name) or []]
                out = F.lit(False)
                for i in items:
                    out = out | equal(a, i)
                return Val(out, flag)
            return Val(F.exists(b.col, lambda e: equal(Val(e, b.type.elementType), a)), flag)
        if x.op in ("<", "<=", ">", ">="):
            return Val(compare(x.op, a, b), flag)
        return arithmetic(x.op, a, b, self.safe)

    def call(self, x: A.Call) -> Val:
        if x.name in AGGREGATES or x.star:
            raise GraphError(f"{x.name}() can't stand here")
        if any(has_aggregate(a) for a in x.args) and not self.known:
            raise GraphError("an aggregate can't be an argument of a function")
        if x.name in ("labels", "type", "keys"):
            if len(x.args) != 1:
                raise GraphError(f"{x.name} needs one argument")
            s = self.scope.get(x.args[0].name) if isinstance(x.args[0], A.Var) else None
            strings = T.ArrayType(T.StringType())
            if x.name == "keys":
                return Val(F.col(f"`{s.keys}`"), strings) if s and s.keys else Val(F.lit(None).cast(strings), strings)
            kind, t = ("node", strings) if x.name == "labels" else ("edge", T.StringType())
            return Val(F.col(f"`{s.labels}`"), t) if s and s.kind == kind and s.labels else Val(F.lit(None).cast(t), t)
        return scalar(x.name, [self.value(a) for a in x.args], self.safe)

    def condition(self, x) -> Column:
        """Of a filter, where null drops a row as false does: conjuncts stay bare, so that they reach the scan."""
        if isinstance(x, A.Bin) and x.op == "AND":
            return self.condition(x.left) & self.condition(x.right)
        if isinstance(x, A.Bin) and x.op in ("<", "<=", ">", ">="):
            return compare(x.op, self.value(x.left), self.value(x.right), bare=True)
        if isinstance(x, A.Call) and x.name.lower() == "startswith" and len(x.args) == 2 and not x.star:
            a, b = self.value(x.args[0]), self.value(x.args[1])
            if is_string(a.type) and b.literal and isinstance(b.value, str):
                return F.startswith(a.col, b.col)
        v = self.value(x)
        return v.col.eqNullSafe(F.lit(True)) if family(v.type) == "bool" else F.lit(False)

    def constant(self, x, what: str) -> Any:
        """The Python value of an expression of literals and parameters."""
        if isinstance(x, A.Lit):
            return x.value
        if isinstance(x, A.Param):
            return self.params.get(x.name)
        if isinstance(x, A.ListExpr):
            return [self.constant(i, what) for i in x.items]
        if isinstance(x, A.Bin) and x.op in "+-*/%":
            a, b = self.constant(x.left, what), self.constant(x.right, what)
            try:
                if x.op == "/":
                    return int(a / b) if isinstance(a, int) and isinstance(b, int) else a / b
                return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b}[x.op]()
            except (TypeError, ZeroDivisionError) as e:
                raise GraphError(f"{what}: {e}") from None
        raise GraphError(f"{what} must be a constant")


class Compiler:
    """One statement over one graph. Lowering runs no job but for paths beyond LAZY_HOPS."""

    def __init__(self, graph: PropertyGraph, params: dict[str, Any] | None = None):
        self.graph, self.params, self.spark = graph, params or {}, graph.spark
        self.fresh = count()
        self.read: set[str] | None = None  # where only counts and extremes of rows are asked for: the variables they need

    def expressions(self, scope, safe=False, known=None) -> Expressions:
        return Expressions(scope, self.params, safe, known)

    # -- queries ----------------------------------------------------------------------------------
    def run(self, stmt) -> DataFrame:
        if isinstance(stmt, A.Union):
            frames = [self.run(p) for p in stmt.parts]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f, allowMissingColumns=True)
            return out if stmt.all else out.distinct()
        self.read = self.read_by(stmt)
        frame, scope = self.bindings(stmt)
        if stmt.with_:
            frame, scope = self.with_clause(stmt.with_, frame, scope)
        if stmt.returns is None:  # a bare CALL
            return frame.select(*[shown(self.expressions(scope).variable(v)).alias(v) for v in scope])
        return self.return_clause(stmt.returns, frame, scope)

    def bindings(self, q: A.Query) -> tuple[DataFrame, dict[str, Sym]]:
        needs, frame, scope = needs_of(q), None, {}
        if q.call:
            frame, scope = self.call(q.call)
        if q.unwind:
            frame, scope = self.unwind(*q.unwind)
        if q.patterns:
            frame, scope = self.match(q.patterns, q.mode, frame, scope, needs)
        if q.where is not None:
            frame = frame.where(self.expressions(scope, safe=True).condition(q.where))
        if q.optional_only:
            frame = self.spark.range(1).select(F.lit(1).alias("__one")).join(frame, F.lit(True), "left")
        for o in q.optionals:
            frame, scope = self.optional(o, frame, scope, needs)
        return frame, scope

    def call(self, c: A.CallStmt) -> tuple[DataFrame, dict[str, Sym]]:
        from lodestone.operators.algorithms import dispatch

        args = {k: self.expressions({}).constant(v, f"argument {k}") for k, v in c.args.items()}
        df, types = dispatch(self.graph, c.name, args)
        names = c.yields if c.yields is not None else list(types)
        unknown = [n for n in names if n not in types]
        if unknown:
            raise GraphError(f"{c.name} doesn't yield {', '.join(unknown)}; it yields {', '.join(types)}")
        scope = {n: Sym("value", f"__{n}__v", types[n] if types[n] is not None else df.schema[n].dataType) for n in names}
        return df.select(*[F.col(n).alias(scope[n].id) for n in names]), scope

    def unwind(self, expr, var: str) -> tuple[DataFrame, dict[str, Sym]]:
        name = f"__{var}__v"
        value = self.params.get(expr.name) if isinstance(expr, A.Param) else None
        if isinstance(value, (list, tuple)) and any(isinstance(x, dict) for x in value):
            return self.rows_of(value, name, var)
        v = self.expressions({}).value(expr)
        if v.type == NULL:
            return self.graph.empty(f"`{name}` string"), {var: Sym("value", name, NULL)}
        if family(v.type) != "list":
            raise GraphError("UNWIND needs a list")
        element = ID if v.type == IDS else v.type.elementType
        return self.spark.range(1).select(F.explode(v.col).alias(name)), {var: Sym("value", name, element)}

    def rows_of(self, rows: list, name: str, var: str) -> tuple[DataFrame, dict[str, Sym]]:
        """A table of a parameter's list of maps: one local table instead of one expression for each row."""
        if not all(isinstance(r, dict) for r in rows):
            raise GraphError("a list of maps can't hold other values")
        keys = list(dict.fromkeys(k for r in rows for k in r))
        kinds, make = {}, {}
        for k in keys:
            found = {type(r[k]) for r in rows if r.get(k) is not None}
            kinds[k], make[k] = (
                (T.BooleanType(), bool) if found == {bool} else (T.LongType(), int) if found == {int}
                else (T.DoubleType(), float) if found and found <= {int, float} else (T.ArrayType(T.StringType()), list) if found == {list} else (T.StringType(), str)
            )
        kind = T.StructType([T.StructField(k, kinds[k]) for k in keys])
        data = [(tuple(None if r.get(k) is None else make[k](r[k]) for k in keys),) for r in rows]
        df = self.spark.createDataFrame(data, T.StructType([T.StructField(name, kind)]))
        return df, {var: Sym("value", name, kind)}

    # -- patterns ---------------------------------------------------------------------------------
    def match(self, patterns, mode, frame, scope, needs, seeds=None) -> tuple[DataFrame, dict[str, Sym]]:
        scope = dict(scope)
        for k, p in enumerate(patterns):
            own = {x.var for x in walk(p) if isinstance(x, (A.NodePattern, A.EdgePattern)) and x.var}
            shared = [v for v in scope if v in own]
            later = None if self.read is None else self.read | {x.var for x in walk(patterns[k + 1 :]) if isinstance(x, (A.NodePattern, A.EdgePattern))}
            few = later is not None and own & later <= set(shared)
            if frame is None or not shared or any(scope[v].kind != "node" for v in shared) or any(e.quantifier for e, _ in p.steps) or not few and p.start.var in shared:
                frame = self.pattern(p, mode, frame, scope, needs, seeds or {})
                continue
            # on its own, so that all its labels hold before it meets the other rows
            inner: dict[str, Sym] = {}
            right = self.pattern(p, mode, None, inner, dict(needs) | {v: set() for v in shared}, seeds or {})
            right = right.drop(*[c for v in shared for c in inner[v].columns()[1:]])  # read by its own conditions only
            inner |= {v: Sym("node", inner[v].id) for v in shared}
            if later is not None:
                frame, scope = self.squeeze(frame, scope, later | set(shared), shared)
                right, inner = self.squeeze(right, inner, later | set(shared), shared)
            tag = f"__m{next(self.fresh)}"
            for v in shared:
                right = right.withColumnRenamed(inner[v].id, inner[v].id + tag)
            if TIMES in right.columns:
                right = right.withColumnRenamed(TIMES, TIMES + tag)
            condition = F.lit(True)
            for v in shared:
                condition = condition & (F.col(f"`{scope[v].id}`") == F.col(f"`{inner[v].id}{tag}`"))
            frame = frame.join(right, condition).drop(*[inner[v].id + tag for v in shared])
            if TIMES + tag in frame.columns:
                both = F.col(TIMES) * F.col(TIMES + tag) if TIMES in frame.columns else F.col(TIMES + tag)
                frame = frame.withColumn(TIMES, both).drop(TIMES + tag)
            scope |= {v: s for v, s in inner.items() if v not in scope}
        return frame, scope

    @staticmethod
    def read_by(q: A.Query) -> set[str] | None:
        """The variables that WHERE and RETURN read, if all that RETURN asks of the rows are counts and extremes: then rows
        that agree in these may go as one with their number."""
        if q.with_ or q.optionals or q.optional_only or q.returns is None or q.returns.star:
            return None
        calls = [x for x in walk(q.returns) if isinstance(x, A.Call) and (x.name in AGGREGATES or x.star)]
        if not calls or any(x.name not in ("count", "min", "max") for x in calls):
            return None
        return {x.name if isinstance(x, A.Var) else x.var for y in (q.returns, q.where) for x in walk(y) if isinstance(x, (A.Var, A.Prop))}

    @staticmethod
    def squeeze(frame: DataFrame, scope: dict[str, Sym], later: set[str], shared: list[str]) -> tuple[DataFrame, dict[str, Sym]]:
        """One row with its number in TIMES for each of the shared nodes, if nothing else is read later."""
        kept = {v: s for v, s in scope.items() if v in later}
        if len(kept) == len(scope) or set(kept) - set(shared):
            return frame, scope
        times = F.sum(TIMES) if TIMES in frame.columns else F.count(F.lit(1))
        return frame.groupBy(*[F.col(f"`{c}`") for s in kept.values() for c in s.columns()]).agg(times.alias(TIMES)), kept

    def constrain(self, df: DataFrame, props, columns: dict[str, tuple[str, Any]]) -> DataFrame:
        ex = self.expressions({}, safe=True)
        for key, value in props:
            column, t = columns.get(key, (None, NULL))
            own = Val(F.col(f"`{column}`") if column else F.lit(None), t if column else NULL)
            df = df.where(equal(own, ex.value(value)))
        return df

    def node_scan(self, n: A.NodePattern, var: str, needs) -> tuple[DataFrame, Sym]:
        want = needs.get(var, set()) | {k for k, _ in n.props}
        props = {p for p in want if p[0] != ":"}
        df, types = self.graph.scan_nodes(n.labels, props, ":labels" in want, ":keys" in want)
        sym = Sym("node", f"__{var}__id", None, {p: (f"__{var}__p__{p}", types[p]) for p in sorted(props)},
                  f"__{var}__labels" if ":labels" in want else "", f"__{var}__keys" if ":keys" in want else "")
        df = df.select(
            F.col("id").alias(sym.id), *[F.col(f"`{p}`").alias(c) for p, (c, _) in sym.props.items()],
            *([F.col("__labels").alias(sym.labels)] if sym.labels else []), *([F.col("__keys").alias(sym.keys)] if sym.keys else []),
        )
        return self.constrain(df, n.props, sym.props), sym

    def pattern(self, p: A.Pattern, mode, frame, scope, needs, seeds) -> DataFrame:
        name = lambda v: v or f"_{next(self.fresh)}"
        var = name(p.start.var)
        plain = lambda n, v: not n.labels and not n.props and not needs.get(v)
        skip = bool(p.steps) and plain(p.start, var) and var not in scope and var not in seeds and not p.steps[0][0].quantifier and frame is None
        if skip:
            scope[var] = Sym("node", f"__{var}__id")
        else:
            frame = self.bind_node(p.start, var, frame, scope, needs, seeds.get(var))
        here, trail, seen = scope[var].id, f"__trail_{next(self.fresh)}", f"__seen_{next(self.fresh)}"
        if not skip:
            if mode == "TRAIL":
                frame = frame.withColumn(trail, F.array().cast("array<long>"))
            if mode == "SIMPLE":
                frame = frame.withColumn(seen, F.array(F.col(f"`{here}`")))
        for edge, node in p.steps:
            evar, tvar = name(edge.var), name(node.var)
            want = needs.get(evar, set()) | {k for k, _ in edge.props}
            props = {x for x in want if x[0] != ":"}
            adj, types = self.graph.adjacency(edge.label, edge.direction, props, ":labels" in want and not edge.quantifier, ":keys" in want and not edge.quantifier)
            cols = {x: (f"__{evar}__p__{x}", types[x]) for x in sorted(props)}
            sym = Sym("edge", f"__{evar}__id", None, cols, f"__{evar}__label" if "__label" in adj.columns else "", f"__{evar}__keys" if "__keys" in adj.columns else "")
            at, to = f"__{evar}__from", f"__{evar}__to"
            adj = adj.select(
                F.col("node").alias(at), F.col("nbr").alias(to), F.col("eid").alias(sym.id), *[F.col(f"`{x}`").alias(c) for x, (c, _) in cols.items()],
                *([F.col("__label").alias(sym.labels)] if sym.labels else []), *([F.col("__keys").alias(sym.keys)] if sym.keys else []),
            )
            adj = self.constrain(adj, edge.props, cols)
            if edge.quantifier:
                frame, sym = self.expand(frame, here, adj, at, to, sym, edge.quantifier, mode, trail, seen, evar, needs)
            elif skip:
                frame, skip = adj.withColumnRenamed(at, here), False
                if mode == "TRAIL":
                    frame = frame.withColumn(trail, F.array(F.col(f"`{sym.id}`")))
                if mode == "SIMPLE":
                    frame = frame.where(F.col(f"`{here}`") != F.col(f"`{to}`")).withColumn(seen, F.array(F.col(f"`{here}`"), F.col(f"`{to}`")))
            else:
                bound = scope.get(evar)
                if bound is not None:  # the same edge again
                    adj = adj.withColumnRenamed(sym.id, sym.id + "_2")
                    own = [c for c in adj.columns if c in frame.columns]
                    frame = frame.join(adj.drop(*own), (F.col(f"`{here}`") == F.col(f"`{at}`")) & (F.col(f"`{bound.id}`") == F.col(f"`{sym.id}_2`"))).drop(at, sym.id + "_2")
                    sym = bound
                else:
                    frame = frame.join(adj, F.col(f"`{here}`") == F.col(f"`{at}`")).drop(at)
                if mode == "TRAIL":
                    frame = frame.where(~F.array_contains(trail, F.col(f"`{sym.id}`"))).withColumn(trail, F.array_append(trail, F.col(f"`{sym.id}`")))
                if mode == "SIMPLE":
                    frame = frame.where(~F.array_contains(seen, F.col(f"`{to}`"))).withColumn(seen, F.array_append(seen, F.col(f"`{to}`")))
            scope[evar] = sym
            frame = self.arrive(node, tvar, frame, to, scope, needs)
            here = scope[tvar].id
        return frame.drop(trail, seen)

    def bind_node(self, n, var, frame, scope, needs, seed=None) -> DataFrame:
        bound = scope.get(var)
        if bound is None:
            df, scope[var] = self.node_scan(n, var, needs)
            if seed is not None:
                df = df.join(seed.toDF(scope[var].id), scope[var].id, "left_semi")
            return df if frame is None else frame.crossJoin(df)
        if bound.kind == "value":  # an id that CALL or WITH gave: the element that it names
            df, scope[var] = self.node_scan(n, var, needs)
            return frame.join(df, F.col(f"`{bound.id}`") == F.col(f"`{scope[var].id}`"))
        if n.labels:
            ids = self.graph.scan_nodes(n.labels, set())[0].select(F.col("id").alias(bound.id))
            frame = frame.join(ids, bound.id, "left_semi")
        return self.constrain(frame, n.props, bound.props)

    def arrive(self, n, var, frame, to, scope, needs) -> DataFrame:
        """Bind the node at the end of a step, whose id is in column ``to``."""
        bound = scope.get(var)
        if bound is not None and bound.kind == "node":
            frame = frame.where(F.col(f"`{bound.id}`") == F.col(f"`{to}`")).drop(to)
            return self.bind_node(n, var, frame, scope, needs)
        if not n.labels and not n.props and not needs.get(var):
            scope[var] = Sym("node", f"__{var}__id")
            return frame.withColumnRenamed(to, scope[var].id)
        df, scope[var] = self.node_scan(n, var, needs)
        return frame.join(df, F.col(f"`{to}`") == F.col(f"`{scope[var].id}`")).drop(to)

    def expand(self, frame, here, adj, at, to, sym, quantifier, mode, trail, seen, evar, needs) -> tuple[DataFrame, Sym]:
        """All paths of so many hops, one row for each; arrays of edges and nodes are kept only if asked for."""
        low, high = quantifier
        cap = high
        if high is None:
            cap = {"WALK": lambda: min(WALK_CAP, self.graph.count("nodes") + 1), "TRAIL": lambda: self.graph.count("edges"), "SIMPLE": lambda: self.graph.count("nodes")}[mode]()
        keep = not evar.startswith("_")
        out = Sym("path", f"__{evar}__path", None, {k: (f"__{evar}__ps__{k}", t) for k, (_, t) in sym.props.items()})
        level = frame.withColumn(to, F.col(f"`{here}`"))
        if keep:
            level = level.withColumn(out.id, F.array().cast("array<long>"))
            for _, (c, t) in out.props.items():
                level = level.withColumn(c, F.array().cast(T.ArrayType(T.StringType() if t == NULL else t)))
        step = adj.withColumnRenamed(to, to + "_n")
        lazy = cap <= LAZY_HOPS and high is not None
        levels = [level] if low == 0 else []
        for hop in range(1, cap + 1):
            level = level.join(step, F.col(f"`{to}`") == F.col(f"`{at}`"))
            if mode == "TRAIL":
                level = level.where(~F.array_contains(trail, F.col(f"`{sym.id}`"))).withColumn(trail, F.array_append(trail, F.col(f"`{sym.id}`")))
            if mode == "SIMPLE":
                level = level.where(~F.array_contains(seen, F.col(f"`{to}_n`"))).withColumn(seen, F.array_append(seen, F.col(f"`{to}_n`")))
            if keep:
                level = level.withColumn(out.id, F.array_append(out.id, F.col(f"`{sym.id}`")))
                for k, (c, _) in out.props.items():
                    level = level.withColumn(c, F.array_append(c, F.col(f"`{sym.props[k][0]}`")))
            level = level.withColumn(to, F.col(f"`{to}_n`")).drop(to + "_n", at, sym.id, *[c for c, _ in sym.props.values()])
            if not lazy:
                level = materialize(level, "paths")
                if level.isEmpty():
                    break
            if hop >= low:
                levels.append(level)
        if not levels:
            levels = [level.limit(0)]
        result = levels[0]
        for x in levels[1:]:
            result = result.unionByName(x)
        return result, out

    def optional(self, o: A.Optional, frame, scope, needs) -> tuple[DataFrame, dict[str, Sym]]:
        """Left join; the clause's WHERE belongs to the join condition."""
        named = {x.var for p in o.patterns for x in walk(p) if isinstance(x, (A.NodePattern, A.EdgePattern)) and x.var}
        shared = [v for v in named if v in scope and scope[v].kind in ("node", "edge")]
        own_needs = {v: set() if v in shared else n for v, n in needs.items()}
        long = any(e.quantifier for p in o.patterns for e, _ in p.steps)
        seeds = {v: frame.select(F.col(f"`{scope[v].id}`")).distinct() for v in shared if scope[v].kind == "node"} if long else {}
        right, inner = self.match(o.patterns, "WALK", None, {}, own_needs, seeds)
        tag = f"__o{next(self.fresh)}"
        used = [c for s in inner.values() for c in s.columns() if c in right.columns]
        right = right.select(*[F.col(f"`{c}`").alias(c + tag) for c in dict.fromkeys(used)])
        condition = F.lit(True)
        for v in shared:
            condition = condition & (F.col(f"`{scope[v].id}`") == F.col(f"`{inner[v].id}{tag}`"))
        new = {v: s.renamed(lambda c: c + tag) for v, s in inner.items() if v not in scope}
        both = scope | new
        if o.where is not None:
            condition = condition & self.expressions(both, safe=True).condition(o.where)
        out = frame.join(right, condition, "left")
        return out.drop(*[inner[v].id + tag for v in shared]), both

    # -- projections ------------------------------------------------------------------------------
    def with_clause(self, w: A.With, frame, scope) -> tuple[DataFrame, dict[str, Sym]]:
        items = [A.Item(A.Var(v), None, v) for v in scope if not v.startswith("_")] if w.star else w.items
        out: dict[str, Sym] = {}
        elements = {}
        ex = self.expressions(scope)
        columns: list[Column] = []
        plain, grouped = [], any(has_aggregate(i.expr) for i in items)
        for i in items:
            name = i.alias or label_of(i.expr, i.text)
            s = scope.get(i.expr.name) if isinstance(i.expr, A.Var) else None
            if s is not None and s.kind != "value":
                new = s.renamed(lambda c, old=i.expr.name, name=name: f"__w_{name}" + c.removeprefix(f"__{old}"))
                elements[name] = new
                columns += [F.col(f"`{a}`").alias(b) for a, b in zip(s.columns(), new.columns())]
                out[name] = new
            elif has_aggregate(i.expr):
                plain.append((name, i.expr))
                out[name] = Sym("value", f"__{name}__v")
            else:
                v = ex.value(i.expr)
                columns.append(v.col.cast("string").alias(f"__{name}__v") if v.type == NULL else v.col.alias(f"__{name}__v"))
                out[name] = Sym("value", f"__{name}__v", v.type)
        if grouped:
            keys = [f"__g{k}" for k in range(len(columns))]
            frame, vals = self.aggregate(frame, [c.alias(k) for c, k in zip(columns, keys)], [e for _, e in plain], ex)
            names = [c for s in out.values() if s.type is not None or s.kind != "value" for c in s.columns()]
            frame = frame.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[v.col.alias(f"__{n}__v") for (n, _), v in zip(plain, vals)])
            for (n, _), v in zip(plain, vals):
                out[n].type = v.type
        else:
            frame = frame.select(*columns)
        if w.distinct:
            frame = frame.distinct()
        if w.where is not None:
            frame = frame.where(self.expressions(out, safe=True).condition(w.where))
        return frame, out

    def aggregate(self, frame, keys: list[Column], exprs: list, ex: Expressions) -> tuple[DataFrame, list[Val]]:
        """Group by ``keys`` and return the columns' values of ``exprs``, which may compute with aggregates."""
        calls = list(dict.fromkeys(y for e in exprs for y in walk(e) if isinstance(y, A.Call) and (y.name in AGGREGATES or y.star)))
        for e in exprs:
            for y in walk(e):
                if isinstance(y, A.Call) and y.name not in AGGREGATES and not y.star and any(has_aggregate(a) for a in y.args):
                    raise GraphError("an aggregate can't be an argument of a function")
        args, aggs, known = [], [], {}
        for k, c in enumerate(calls):
            out = f"__agg{k}"
            if c.star or not c.args:
                if c.name != "count":
                    raise GraphError(f"{c.name}() needs an argument")
                aggs.append((F.coalesce(F.sum(TIMES), F.lit(0)) if TIMES in frame.columns else F.count(F.lit(1))).alias(out))
                known[c] = Val(F.col(out), T.LongType())
                continue
            if any(has_aggregate(a) for a in c.args):
                raise GraphError("an aggregate in an aggregate")
            v = ex.value(c.args[0])
            args.append((v.col.cast("string") if v.type == NULL else v.col).alias(f"__arg{k}"))
            f, t = self.aggregate_of(c, F.col(f"__arg{k}"), v.type)
            if c.name == "count" and not c.distinct and TIMES in frame.columns:
                f = F.coalesce(F.sum(F.when(F.col(f"__arg{k}").isNotNull(), F.col(TIMES))), F.lit(0))
            aggs.append(f.alias(out))
            known[c] = Val(F.col(out), t)
        grouped = frame.select(*keys, *args, *([TIMES] if TIMES in frame.columns else [])) if args or keys else frame
        names = grouped.columns[: len(keys)]
        grouped = grouped.groupBy(*names).agg(*aggs) if names else grouped.agg(*aggs)
        post = self.expressions(ex.scope, known=known)
        return grouped, [post.value(e) for e in exprs]

    @staticmethod
    def aggregate_of(c: A.Call, arg: Column, t) -> tuple[Column, Any]:
        if c.name == "count":
            return (F.count_distinct(arg) if c.distinct else F.count(arg)), T.LongType()
        if c.name in ("sum", "avg"):
            if t == TAGGED:
                arg, t = F.coalesce(arg["d"], arg["i"].cast("double")), T.DoubleType()
            if not (is_int(t) or is_float(t) or t == NULL):
                raise GraphError(f"{c.name}() needs numbers")
            if c.name == "avg":
                return F.avg(arg.cast("double")), T.DoubleType()
            wide = T.LongType() if is_int(t) or t == NULL else T.DoubleType()
            return (F.sum_distinct if c.distinct else F.sum)(arg.cast(wide)), wide
        if c.name in ("min", "max"):
            return (F.min if c.name == "min" else F.max)(arg), T.StringType() if t == NULL else t
        got = (F.collect_set if c.distinct else F.collect_list)(arg)
        return F.sort_array(got), IDS if t == ID else T.ArrayType(T.StringType() if t == NULL else t)

    def return_clause(self, r: A.Return, frame, scope) -> DataFrame:
        items = r.items
        if r.star:
            items = [A.Item(A.Var(v), None, v) for v in scope if not v.startswith("_")]
            if not items:
                raise GraphError("RETURN * without variables")
        named = {}
        for i in items:
            named[i.alias or label_of(i.expr, i.text)] = i
        ex, grouped = self.expressions(scope), any(has_aggregate(i.expr) for i in items)
        by_expr = {self.key(i.expr): n for n, i in named.items()}
        order, hidden = [], []
        for e, up in r.order:
            name = e.name if isinstance(e, A.Var) and e.name in named else by_expr.get(self.key(e))
            if name is None and label_of(e, "") in named:
                name = label_of(e, "")
            if name is None:
                if grouped and not has_aggregate(e):
                    raise GraphError("ORDER BY after an aggregate takes what RETURN names")
                name = f"__sort{len(hidden)}"
                hidden.append((name, e))
            order.append((name, up))
        exprs = [(n, i.expr) for n, i in named.items()] + hidden
        if grouped:
            keys = [(n, e) for n, e in exprs if not has_aggregate(e)]
            aggs = [(n, e) for n, e in exprs if has_aggregate(e)]
            values = {n: ex.value(e) for n, e in keys}
            frame, vals = self.aggregate(frame, [v.col.alias(f"__k{k}") for k, v in enumerate(values.values())], [e for _, e in aggs], ex)
            values = {n: Val(F.col(f"__k{k}"), v.type) for k, (n, v) in enumerate(values.items())} | {n: v for (n, _), v in zip(aggs, vals)}
        else:
            values = {n: ex.value(e) for n, e in exprs}
        out = frame.select(*[shown(values[n]).alias(n) for n, _ in exprs])
        visible = list(named)
        if r.distinct and hidden and not grouped:
            flags = dict(order)
            pick = [(F.min if flags[n] else F.max)(F.col(f"`{n}`")).alias(n) for n, _ in hidden]
            out = out.groupBy(*[F.col(f"`{v}`") for v in visible]).agg(*pick)
        elif r.distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*[F.col(f"`{n}`").asc_nulls_last() if up else F.col(f"`{n}`").desc_nulls_first() for n, up in order])
        for x, what in ((r.offset, "OFFSET"), (r.limit, "LIMIT")):
            if x is None:
                continue
            n = ex.constant(x, what)
            if isinstance(n, bool) or not isinstance(n, int):
                raise GraphError(f"{what} must be an integer")
            out = out.offset(max(0, n)) if what == "OFFSET" else out.limit(max(0, n))
        return out.select(*[F.col(f"`{v}`") for v in visible]) if hidden else out

    @staticmethod
    def key(e) -> str:
        return repr(e)
