"""Graph algorithms behind CALL: DataFrame iterations, and kernels where the order of steps matters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.errors import GraphError
from lodestone.functions.scalars import ID, IDS, ulid_value
from lodestone.operators.blocks import PATHS, STEP, Blocks, alike, all_dependencies, distances, numbered, renumber, weighted_dependencies
from lodestone.operators.components import connected_components
from lodestone.operators.flow import maximum_flow
from lodestone.shared import forget, materialize
from lodestone.sources.graph import PropertyGraph, is_float, is_int


class Args:
    """Checked arguments of one call; unknown ones are ignored."""

    def __init__(self, name: str, given: dict[str, Any]):
        self.name, self.given = name, given

    def node(self, key: str, required: bool = False) -> int | None:
        v = self.given.get(key)
        if v is None:
            if required:
                raise GraphError(f"{self.name}: '{key}' is required")
            return None
        if isinstance(v, str):
            return ulid_value(v)
        if isinstance(v, int) and not isinstance(v, bool):
            return v
        raise GraphError(f"{self.name}: '{key}' must be a node id")

    def number(self, key: str, default, low=None, high=None, whole=False, open_low=False, open_high=False):
        v = self.given.get(key)
        if v is None:
            return default
        if isinstance(v, bool) or not isinstance(v, int if whole else (int, float)):
            raise GraphError(f"{self.name}: '{key}' must be {'an integer' if whole else 'a number'}")
        if low is not None and (v < low or open_low and v == low) or high is not None and (v > high or open_high and v == high):
            raise GraphError(f"{self.name}: '{key}' is out of range")
        return v

    def flag(self, key: str, default: bool) -> bool:
        v = self.given.get(key, default)
        if not isinstance(v, bool):
            raise GraphError(f"{self.name}: '{key}' must be true or false")
        return v

    def text(self, key: str, default: str = "", of: tuple[str, ...] = ()) -> str:
        v = self.given.get(key)
        v = default if v is None else v
        if not isinstance(v, str) or of and v not in of:
            raise GraphError(f"{self.name}: '{key}' must be {' or '.join(of) or 'a string'}")
        return v

    def direction(self, default: str = "out") -> str:
        v = str(self.given.get("direction") or default)
        names = {"out": "out", "outgoing": "out", "in": "in", "incoming": "in", "any": "any", "both": "any"}
        if v not in names:
            raise GraphError(f"{self.name}: 'direction' must be out, in or any")
        return names[v]


def weighted(graph: PropertyGraph, direction: str, prop: str, missing: float = 1.0) -> DataFrame:
    """(``node``, ``nbr``, ``eid``, ``w``) of all edges; a missing or non-numeric weight is ``missing``."""
    adj, types = graph.adjacency(None, direction, {prop} if prop else set())
    w = F.lit(float(missing))
    if prop and (is_int(types[prop]) or is_float(types[prop])):
        w = F.coalesce(F.col(f"`{prop}`").cast("double"), w)
    return adj.select("node", "nbr", "eid", w.alias("w"))


def both_ways(graph: PropertyGraph, direction: str) -> DataFrame:
    """Distinct (``node``, ``nbr``) without self-loops."""
    return graph.adjacency(None, direction)[0].where("node <> nbr").select("node", "nbr").distinct()


def node_ids(graph: PropertyGraph) -> DataFrame:
    return graph.scan_nodes([], set())[0].select(F.col("id").alias("node"))


def reach(graph: PropertyGraph, start: int, direction: str, depth: int | None = None) -> DataFrame:
    """(``node``, ``depth``, ``predecessor``) of all nodes reached from ``start`` in the fewest hops; of several
    predecessors the smallest. One join and one grouped minimum for each level."""
    adj = materialize(graph.adjacency(None, direction)[0].select("node", "nbr").distinct(), "adjacency")
    seen = node_ids(graph).where(F.col("node") == start).select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("predecessor"))
    seen = frontier = materialize(seen, "bfs")
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select("node").join(adj, "node").groupBy("nbr").agg(F.min("node").alias("predecessor"))
        step = step.join(seen.select(F.col("node").alias("nbr")), "nbr", "left_anti")
        frontier = materialize(step.select(F.col("nbr").alias("node"), F.lit(level).cast("long").alias("depth"), "predecessor"), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def bfs(graph: PropertyGraph, a: Args):
    start, direction = a.node("start", True), a.direction()
    depth = a.number("maxDepth", None, 0, whole=True)
    if a.text("algorithm", "dfs" if a.name == "dfs" else "bfs", ("bfs", "dfs")) == "dfs":
        return depth_first(graph, start, direction, depth), {"node": ID, "depth": None, "predecessor": ID}
    return reach(graph, start, direction, depth), {"node": ID, "depth": None, "predecessor": ID}


def depth_first(graph: PropertyGraph, start: int, direction: str, depth: int | None) -> DataFrame:
    """Pre-order walk with an explicit stack, neighbours in the order of edge ids. The order makes it
    sequential: the edges of what ``start`` reaches go to one task."""
    found = reach(graph, start, direction, None)
    adj = graph.adjacency(None, direction)[0].join(found.select("node"), "node")

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        out_edges = defaultdict(list)
        for e, n, m in sorted(zip(rows["eid"], rows["node"], rows["nbr"])):
            out_edges[n].append(m)
        stack, done, out = [(start, 0, None)], set(), []
        while stack:
            node, d, pred = stack.pop()
            if node in done:
                continue
            done.add(node)
            out.append((node, d, pred))
            if depth is None or d < depth:
                stack += [(m, d + 1, node) for m in reversed(out_edges[node]) if m not in done]
        return pd.DataFrame(out, columns=["node", "depth", "predecessor"]).astype({"predecessor": "Int64"})

    alone = found.where("depth = 0").select(F.lit(start).cast("long").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(-1).cast("long").alias("eid"))
    rows = adj.select("node", "nbr", "eid").unionByName(alone).where("nbr is not null or eid = -1")
    return rows.fillna({"nbr": start}).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(go, "node long, depth long, predecessor long")


def shortest_path(graph: PropertyGraph, a: Args):
    """Label-correcting relaxation: the best (cost, path) of each node, improved by the frontier until nothing
    changes; beyond ``maxCost`` or the target's best cost nothing is followed."""
    source, target, direction = a.node("source", True), a.node("target"), a.direction()
    limit = a.number("maxCost", None, 0)
    adj = materialize(weighted(graph, direction, a.text("weight")).groupBy("node", "nbr").agg(F.min("w").alias("w")), "adjacency")
    types = {"source": ID, "target": ID, "cost": None, "path": IDS}
    best = node_ids(graph).where(F.col("node") == source).select("node", F.lit(0.0).alias("cost"), F.array(F.lit(source).cast("long")).alias("path"))
    best = frontier = materialize(best, "paths")
    bound = limit
    while True:
        w = F.when(F.col("w") < 0, F.raise_error(F.lit("shortestPath: negative weight")).cast("double")).otherwise(F.col("w"))
        step = frontier.join(adj, "node").select("nbr", (F.col("cost") + w).alias("cost"), "path")
        if bound is not None:
            step = step.where(F.col("cost") <= bound)
        step = step.groupBy("nbr").agg(F.min(F.struct("cost", F.array_append("path", F.col("nbr")).alias("path"))).alias("b"))
        step = step.select(F.col("nbr").alias("node"), "b.cost", "b.path")
        old = best.select("node", F.col("cost").alias("old"))
        frontier = materialize(step.join(old, "node", "left").where("old is null or cost < old").drop("old"), "paths")
        if frontier.isEmpty():
            break
        best = materialize(best.join(frontier.select("node"), "node", "left_anti").union(frontier), "paths")
        if target is not None:
            hit = best.where(F.col("node") == target).select("cost").head()
            if hit:
                bound = hit[0] if limit is None else min(limit, hit[0])
    best = best.where(F.col("node") == target) if target is not None else best.where(F.col("node") != source)
    return best.select(F.lit(source).cast("long").alias("source"), F.col("node").alias("target"), "cost", "path"), types


def sized(nodes: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    out = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = out.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return out.join(size, "component").select("node", "component", "size")


PARTS = {"node": ID, "component": ID, "size": None}


def wcc(graph: PropertyGraph, a: Args):
    least = a.number("minSize", 1, 1, whole=True)
    edges = graph.scan_edges(None, set())[0].select("src", "dst")
    return sized(node_ids(graph), connected_components(edges), least), PARTS


def scc(graph: PropertyGraph, a: Args):
    """Trim nodes without a way in or out, colour the rest by the largest id that reaches them, and take from
    each colour what leads back to its root; repeat on what is left."""
    least = a.number("minSize", 1, 1, whole=True)
    left = materialize(graph.adjacency(None, "out")[0].where("node <> nbr").select("node", "nbr").distinct(), "scc")
    found = None
    while True:
        while True:  # trimming
            ends = left.select("node").distinct().join(left.select(F.col("nbr").alias("node")).distinct(), "node")
            inner = left.join(ends, "node", "left_semi").join(ends.withColumnRenamed("node", "nbr"), "nbr", "left_semi").select("node", "nbr")
            inner = materialize(inner, "scc")
            same = inner.count() == left.count()
            forget(left)
            left = inner
            if same:
                break
        if left.isEmpty():
            break
        colour = materialize(left.select("node").distinct().select("node", F.col("node").alias("c")), "scc")
        while True:
            come = left.join(colour, "node").groupBy("nbr").agg(F.max("c").alias("m")).withColumnRenamed("nbr", "node")
            after = colour.join(come, "node", "left").select("node", F.greatest("c", "m").alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("up"))
            after = materialize(after, "scc")
            moved = not after.where("up").isEmpty()
            forget(colour)
            colour = after.drop("up")
            if not moved:
                break
        back = left.join(colour, "node").join(colour.select(F.col("node").alias("nbr"), F.col("c").alias("c2")), "nbr").where("c = c2").select("node", "nbr", "c")
        back = materialize(back, "scc")
        part = frontier = materialize(colour.where("node = c").select("node", F.col("c").alias("component")), "scc")
        while True:
            step = back.join(frontier.select(F.col("node").alias("nbr")), "nbr").select("node", F.col("c").alias("component")).distinct()
            frontier = materialize(step.join(part.select("node"), "node", "left_anti"), "scc")
            if frontier.isEmpty():
                break
            part = part.union(frontier)
        found = part if found is None else found.union(part)
        rest = left.join(part.select("node"), "node", "left_anti").join(part.select(F.col("node").alias("nbr")), "nbr", "left_anti")
        left = materialize(rest.select("node", "nbr"), "scc")
    if found is None:
        return sized(node_ids(graph), graph.empty("node long, component long"), least), PARTS
    named = found.groupBy("component").agg(F.min("node").alias("least"))  # the smallest member names it
    found = found.join(named, "component").select("node", F.col("least").alias("component"))
    return sized(node_ids(graph), found, least), PARTS


def page_rank(graph: PropertyGraph, a: Args):
    d = a.number("damping", 0.85, 0, 1, open_low=True, open_high=True)
    rounds, tolerance = a.number("iterations", 20, 1, whole=True), a.number("tolerance", 1e-6, 0)
    normalize = a.flag("normalize", True)
    out = weighted(graph, "out", a.text("weight")).withColumn("w", F.greatest("w", F.lit(0.0)))
    total = out.groupBy("node").agg(F.sum("w").alias("total"))
    # the share that each neighbour gets; parallel edges are summed once, before the iterations
    share = out.groupBy("node", "nbr").agg(F.sum("w").alias("w")).join(total, "node")
    share = materialize(share.select("node", "nbr", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("share")), "rank-edges")
    nodes = materialize(node_ids(graph).join(total.select("node", F.lit(False).alias("ends")), "node", "left").select("node", F.coalesce("ends", F.lit(True)).alias("ends")), "rank-nodes")
    n, loose = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("ends").cast("int")), F.lit(0))).head()
    types = {"node": ID, "score": None}
    if not n:
        return graph.empty("node long, score double"), types
    rank, dangling = nodes.withColumn("score", F.lit(1.0 / n)), loose / n
    for _ in range(rounds):
        got = rank.join(share, "node").groupBy("nbr").agg(F.sum(F.col("score") * F.col("share")).alias("got")).withColumnRenamed("nbr", "node")
        new = F.lit((1 - d) / n + d * dangling / n) + F.lit(d) * F.coalesce("got", F.lit(0.0))
        after = materialize(rank.join(got, "node", "left").select("node", "ends", new.alias("score"), F.abs(new - F.col("score")).alias("change")), "rank")
        dangling, change = after.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("score"))), F.lit(0.0)), F.max("change")).head()
        rank = after.drop("change")
        if change < tolerance:
            break
    total = rank.agg(F.sum("score")).head()[0] if normalize else 1.0
    return rank.select("node", (F.col("score") / F.lit(total or 1.0)).alias("score")), types


def degree(graph: PropertyGraph, a: Args):
    kind, normalized = a.text("direction", "total", ("in", "out", "total")), a.flag("normalized", True)
    edges = graph.scan_edges(None, set())[0]
    ends = edges.select(F.col("src").alias("node"), F.when(F.col("directed"), 0).otherwise(1).alias("i"), F.lit(1).alias("o"))
    ends = ends.union(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.when(F.col("directed"), 0).otherwise(1).alias("o")))
    zero = node_ids(graph).select("node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    out = ends.union(zero).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    own = {"in": F.col("in_degree"), "out": F.col("out_degree"), "total": F.col("in_degree") + F.col("out_degree")}[kind]
    by = max(graph.count("nodes") - 1, 1) if normalized else 1
    types = {"node": ID, "in_degree": None, "out_degree": None, "degree": None, "score": None}
    return out.select("node", "in_degree", "out_degree", own.alias("degree"), (own.cast("double") / by).alias("score")), types


def triangles(graph: PropertyGraph, a: Args):
    """Each edge is directed from the end of lower degree (then id), so a hub opens few wedges; wedges are
    closed by a join with the edges."""
    mode = a.text("mode", "local", ("local", "global"))
    pair = graph.scan_edges(None, set())[0].where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pair = materialize(pair, "pairs")
    deg = materialize(pair.select(F.col("u").alias("node")).union(pair.select("v")).groupBy("node").agg(F.count(F.lit(1)).alias("d")), "degrees")
    e = pair.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    e = e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
    found = wedge.join(pair.toDF("b", "c"), ["b", "c"]).select("a", "b", "c")
    if mode == "global":
        t = found.agg(F.count(F.lit(1)).alias("triangles"))
        w = deg.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("w"))
        out = t.join(w, F.lit(True))
        return out.select("triangles", F.when(F.col("w") > 0, 3.0 * F.col("triangles") / F.col("w")).otherwise(0.0).alias("transitivity")), {"triangles": None, "transitivity": None}
    each = found.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = node_ids(graph).join(each, "node", "left").join(deg, "node", "left")
    t = F.coalesce("triangles", F.lit(0))
    share = F.when(F.col("d") >= 2, t * 2.0 / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return out.select("node", t.alias("triangles"), share.alias("coefficient")), {"node": ID, "triangles": None, "coefficient": None}


def jaccard(graph: PropertyGraph, a: Args):
    """A task counts what its rows share with all others from sorted files, so no pair but the best is written."""
    only, direction, top = a.node("node"), a.direction("any"), a.number("topK", 10, 1, whole=True)
    method = a.text("method", "jaccard", ("jaccard", "overlap", "commonNeighbors"))
    types = {"node1": ID, "node2": ID, "score": None}
    nodes = graph.adjacency(None, direction)[0]
    ids, n = numbered(nodes.select("node").union(nodes.select("nbr")).distinct())
    first, end = 0, n
    if only is not None:
        own = ids.where(F.col("node") == only).head()
        first, end = (own["i"], own["i"] + 1) if own else (0, 0)
    if first == end:
        return graph.empty("node1 long, node2 long, score double"), types
    adj = renumber(both_ways(graph, direction), ids)
    left = Blocks(adj, n)
    right = left if direction == "any" else Blocks(adj.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")), n)
    width = max(1, min(1024, -(-(end - first) // (16 * graph.spark.sparkContext.defaultParallelism))))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        degree, common = left.degrees(), right.degrees()
        for batch in batches:
            for start in batch["id"]:
                rows = np.arange(start, min(end, start + width))
                work = np.zeros(len(rows))  # entries that each row meets
                for which, nbr, _ in left.expand(rows):
                    work += np.bincount(which, common[nbr], len(rows))
                part = np.cumsum(work) // STEP
                for some in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                    found = list(alike(left, right, degree, some, method, top))
                    if found:
                        yield pd.DataFrame(dict(zip(("i", "j", "score"), map(np.concatenate, zip(*found)))))

    best = graph.spark.range(first, end, width, min(-(-(end - first) // width), 64 * graph.spark.sparkContext.defaultParallelism))
    best = best.mapInPandas(go, "i long, j long, score double")
    best = best.join(ids.toDF("node1", "i"), "i").join(ids.toDF("node2", "j"), "j")
    return best.select("node1", "node2", "score"), types


def label_propagation(graph: PropertyGraph, a: Args):
    rounds, direction = a.number("maxIterations", 10, 1, whole=True), a.direction("any")
    adj = materialize(both_ways(graph, direction), "neighbours")
    now = materialize(node_ids(graph).select("node", F.col("node").alias("community")), "labels")
    for _ in range(rounds):
        votes = adj.join(now.select(F.col("node").alias("nbr"), "community"), "nbr").groupBy("node", "community").agg(F.count(F.lit(1)).alias("c"))
        best = votes.groupBy("node").agg(F.max(F.struct("c", (-F.col("community")).alias("m"))).alias("b")).select("node", (-F.col("b.m")).alias("new"))
        after = now.join(best, "node", "left").select("node", F.coalesce("new", "community").alias("community"), (F.coalesce("new", "community") != F.col("community")).alias("moved"))
        after = materialize(after, "labels")
        moved = not after.where("moved").isEmpty()
        forget(now)
        now = after.drop("moved")
        if not moved:
            break
    return now, {"node": ID, "community": ID}


# -- kernels that read the graph in blocks ------------------------------------------------------------


def betweenness(graph: PropertyGraph, a: Args):
    """Brandes: each source's dependencies come from one pass; sources are dealt over the tasks, each of which
    sums its own, and the sums are added up by node."""
    normalized, directed, prop = a.flag("normalized", True), a.flag("directed", True), a.text("weight")
    sample = a.number("sampleSize", 0, 0, whole=True)
    types = {"node": ID, "score": None}
    ids, n = numbered(node_ids(graph))
    if not n:
        return graph.empty("node long, score double"), types
    adj = weighted(graph, "out" if directed else "any", prop).select("node", "nbr", *(["w"] if prop else []))
    adj = renumber(adj.where("node <> nbr"), ids)
    out = Blocks(adj, n)
    into = out if prop or not directed else Blocks(adj.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")), n)
    step, count = (n // sample, sample) if sample and sample < n else (1, n)
    together = max(1, min(64, (1 << 16) // n, PATHS // max(1, out.rows)))  # small graphs; in large ones a source has work enough

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = np.zeros(n)
        degrees = None if prop else (out.degrees(), into.degrees())
        for batch in batches:
            sources = batch["id"].to_numpy()
            for first in range(0, len(sources), together):
                some = sources[first : first + together]
                if prop:
                    for s in some.tolist():
                        score += weighted_dependencies(out, s)
                else:
                    score += all_dependencies(out, into, degrees, some)
        found = np.flatnonzero(score)
        yield pd.DataFrame({"i": found, "score": score[found]})

    tasks = min(-(-count // together), 8 * graph.spark.sparkContext.defaultParallelism)
    total = graph.spark.range(0, count * step, step, tasks).mapInPandas(go, "i long, score double")
    total = total.groupBy("i").agg(F.sum("score").alias("score"))
    factor = n / count  # both directions of a pair count where edges aren't directed
    if normalized and n > 2:
        factor *= (1.0 if directed else 2.0) / ((n - 1) * (n - 2))
    return ids.join(total, "i", "left").select("node", (F.coalesce("score", F.lit(0.0)) * factor).alias("score")), types


def closeness(graph: PropertyGraph, a: Args):
    """Reached nodes over the sum of their distances, from breadth-first searches of many nodes at once."""
    normalized, improved, direction = a.flag("normalized", True), a.flag("wfImproved", True), a.direction()
    types = {"node": ID, "score": None}
    ids, n = numbered(node_ids(graph))
    if not n:
        return graph.empty("node long, score double"), types
    back = {"out": "in", "in": "out", "any": "any"}[direction]
    into = Blocks(renumber(both_ways(graph, back), ids), n)
    width = 64 * max(1, min(32, (1 << 22) // n))  # three bit maps of this width for each node are held

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in batch["id"]:
                sources = np.arange(first, min(n, first + width))
                found, total = distances(into, sources)
                score = np.where(total > 0, found / np.maximum(total, 1), 0.0)
                if improved and n > 1:
                    score *= (found / (n - 1)) ** 2
                yield pd.DataFrame({"i": sources, "score": score if normalized else score * (n - 1)})

    tasks = min(-(-n // width), 16 * graph.spark.sparkContext.defaultParallelism)
    scores = graph.spark.range(0, n, width, tasks).mapInPandas(go, "i long, score double")
    return ids.join(scores, "i").select("node", "score"), types


# -- communities ------------------------------------------------------------------------------------


def _move(adj: list[dict[int, float]], k: np.ndarray, m2: float, gamma: float, passes: int, com: list[int]) -> list[int]:
    """Local moves in the order of nodes: to the neighbouring community of the highest gain, if that is above
    staying; equal gains go to the smallest community."""
    total = defaultdict(float)
    for i, c in enumerate(com):
        total[c] += k[i]
    for _ in range(passes):
        moved = False
        for i, near in enumerate(adj):
            own = com[i]
            to = defaultdict(float)
            for j, w in near.items():
                if j != i:
                    to[com[j]] += w
            total[own] -= k[i]
            best, gain = own, to[own] - gamma * k[i] * total[own] / m2
            for c in sorted(to):
                g = to[c] - gamma * k[i] * total[c] / m2
                if g > gain + 1e-12:
                    best, gain = c, g
            total[best] += k[i]
            if best != own:
                com[i], moved = best, True
        if not moved:
            break
    return com


def _refine(adj, k, m2, gamma, theta, com) -> list[int]:
    """From singletons, merge within each community where the link is at least theta of the node's weight."""
    ref, total, alone = list(range(len(adj))), dict(enumerate(k)), [True] * len(adj)
    for i, near in enumerate(adj):
        if not alone[i]:
            continue
        to = defaultdict(float)
        for j, w in near.items():
            if j != i and com[j] == com[i]:
                to[ref[j]] += w
        best, gain = ref[i], 0.0
        for c in sorted(to):
            if c != ref[i] and to[c] >= theta * k[i]:
                g = to[c] - gamma * k[i] * total[c] / m2
                if g > gain + 1e-12:
                    best, gain = c, g
        if best != ref[i]:
            total[ref[i]] -= k[i]
            total[best] += k[i]
            alone[best] = alone[i] = False
            ref[i] = best
    return ref


def _communities(rows: pd.DataFrame, m2: float, gamma: float, passes: int, levels: int, theta: float | None) -> pd.DataFrame:
    ids = np.unique(np.concatenate([rows["src"], rows["dst"]]))
    at = {int(x): i for i, x in enumerate(ids)}
    adj: list[dict[int, float]] = [defaultdict(float) for _ in ids]
    for u, v, w in zip(rows["src"], rows["dst"], rows["w"]):
        adj[at[u]][at[v]] += w
        adj[at[v]][at[u]] += w
    k = np.array([sum(x.values()) for x in adj])
    member = list(range(len(ids)))
    for _ in range(levels):
        com = _move(adj, k, m2, gamma, passes, list(range(len(adj))))
        part = com if theta is None else _refine(adj, k, m2, gamma, theta, com)
        names = {c: i for i, c in enumerate(sorted(set(part)))}
        if len(names) == len(adj):
            if theta is not None:
                member = [com[x] for x in member] if len(set(com)) == len(com) else member
            break
        small: list[dict[int, float]] = [defaultdict(float) for _ in names]
        weight = np.zeros(len(names))
        for i, near in enumerate(adj):
            weight[names[part[i]]] += k[i]
            for j, w in near.items():
                small[names[part[i]]][names[part[j]]] += w
        member, adj, k = [names[part[x]] for x in member], small, weight
    least: dict[int, int] = {}
    for i, c in enumerate(member):
        least[c] = min(least.get(c, int(ids[i])), int(ids[i]))
    return pd.DataFrame({"node": ids, "community": [least[c] for c in member]})


def louvain(graph: PropertyGraph, a: Args):
    """Sequential moves within each weakly connected component, which are independent but for the total weight:
    one task for each component."""
    gamma = a.number("resolution", 1.0, 0, open_low=True)
    passes, levels = a.number("maxPasses", 10, 1, whole=True), a.number("maxLevels", 10, 1, whole=True)
    theta = a.number("theta", 0.01, 0, 1) if a.name == "leiden" else None
    prop = a.text("weight")
    edges, types = graph.scan_edges(None, {prop} if prop else set())
    w = F.lit(1.0)
    if prop and (is_int(types[prop]) or is_float(types[prop])):
        w = F.coalesce(F.col(f"`{prop}`").cast("double"), w)
    edges = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).where("w > 0")
    edges = materialize(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "weights")
    m2 = 2 * (edges.agg(F.sum("w")).head()[0] or 0.0)
    parts = connected_components(edges.select("src", "dst")).withColumnRenamed("node", "src")
    own = edges.join(parts, "src").groupBy("component").applyInPandas(
        lambda rows: _communities(rows.sort_values(["src", "dst"]), m2, gamma, passes, levels, theta), "node long, community long"
    )
    out = node_ids(graph).join(own, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    return out, {"node": ID, "community": ID}


def max_flow(graph: PropertyGraph, a: Args):
    """Dinic over the nodes that the source reaches and that reach the sink. Each round depends on the one before, so it is
    one task, which reads the edges from sorted files and keeps those of these nodes."""
    source, sink, prop = a.node("source", True), a.node("sink", True), a.text("capacity", "capacity")
    if source == sink:
        raise GraphError("maxFlow: source and sink are the same")
    edges, types = graph.scan_edges(None, {prop})
    cap = F.lit(0.0)
    if is_int(types[prop]) or is_float(types[prop]):
        cap = F.coalesce(F.col(f"`{prop}`").cast("double"), cap)
    edges = edges.where("src <> dst").select("src", "dst", cap.alias("w"), "directed")
    if not edges.where("w < 0").isEmpty():
        raise GraphError("maxFlow: negative capacity")
    ids, n = numbered(node_ids(graph))
    known = dict(map(tuple, ids.where(F.col("node").isin(source, sink)).collect()))
    if len(known) < 2:
        raise GraphError("maxFlow: no such node")
    edges = edges.select("src", "dst", "w").union(edges.where("not directed").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    edges = edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("nbr")).agg(F.sum("w").alias("w")).where("w > 0")
    adj = renumber(edges, ids)
    out, into = Blocks(adj, n), Blocks(adj.select(F.col("nbr").alias("node"), F.col("node").alias("nbr")), n)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"maxFlow": [maximum_flow(out, into, known[source], known[sink])]})

    got = graph.spark.range(0, 1, 1, 1).mapInPandas(go, "maxFlow double")
    ends = [F.lit(x).cast("long").alias(name) for x, name in ((source, "source"), (sink, "sink"))]
    return got.select(*ends, "maxFlow"), {"source": ID, "sink": ID, "maxFlow": None}


ALGORITHMS = {
    "bfs": bfs, "dfs": bfs, "shortestPath": shortest_path, "wcc": wcc, "scc": scc, "pageRank": page_rank, "pagerank": page_rank,
    "betweennessCentrality": betweenness, "closenessCentrality": closeness, "degreeCentrality": degree, "triangleCount": triangles,
    "jaccardSimilarity": jaccard, "labelPropagation": label_propagation, "louvain": louvain, "leiden": louvain, "maxFlow": max_flow,
}


def dispatch(graph: PropertyGraph, name: str, given: dict[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """The algorithm's rows and its columns (ID or IDS where they hold element ids)."""
    if name not in ALGORITHMS:
        raise GraphError(f"unknown algorithm '{name}'; known are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name](graph, Args(name, given))
