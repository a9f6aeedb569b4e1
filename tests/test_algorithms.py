"""Graph algorithms on graphs small enough to know the answer."""

import random
import time

import numpy as np
import pytest

from lodestone.errors import GraphError
from lodestone.operators import blocks
from lodestone.operators.algorithms import dispatch
from lodestone.sources.graph import EdgePart, NodePart, PropertyGraph


def graph(spark, n, edges, directed=True):
    nodes = spark.range(1, n + 1).select("id")
    rows = [(100 + i, e[0], e[1], directed, float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
    df = spark.createDataFrame(rows, "id long, src long, dst long, directed boolean, w double")
    return PropertyGraph(spark, (NodePart(frozenset(["N"]), nodes),), (EdgePart("E", df, directed),))


def call(g, name, **args):
    df, _ = dispatch(g, name, args)
    return sorted(tuple(r) for r in df.collect())


CLIQUES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]


def test_traversal(spark):
    g = graph(spark, 5, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert call(g, "bfs", start=1) == [(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2)]
    assert call(g, "bfs", start=4, direction="in", maxDepth=1) == [(2, 1, 4), (3, 1, 4), (4, 0, None)]
    assert call(g, "dfs", start=1) == [(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2)]
    assert call(g, "dfs", start=5) == [(5, 0, None)]


def test_shortest_path(spark):
    g = graph(spark, 4, [(1, 2, 10), (1, 3, 1), (3, 2, 2)])
    assert call(g, "shortestPath", source=1, target=2, weight="w") == [(1, 2, 3.0, [1, 3, 2])]
    assert call(g, "shortestPath", source=1, target=2) == [(1, 2, 1.0, [1, 2])]
    assert call(g, "shortestPath", source=1, weight="w", maxCost=2) == [(1, 3, 1.0, [1, 3])]
    assert call(g, "shortestPath", source=1, target=4) == []
    assert call(g, "shortestPath", source=1, target=1) == [(1, 1, 0.0, [1])]


def test_components(spark):
    g = graph(spark, 7, CLIQUES)
    assert call(g, "wcc", minSize=2) == [(i, 1 if i < 4 else 4, 3) for i in range(1, 7)]
    g = graph(spark, 5, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)])
    assert call(g, "scc") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)]
    assert call(graph(spark, 3, [(1, 2), (2, 3)]), "scc") == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]


def test_centrality(spark):
    star = graph(spark, 4, [(2, 1), (3, 1), (4, 1)])
    ranks = dict(call(star, "pageRank"))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == 1
    path = graph(spark, 3, [(1, 2), (2, 3)])
    assert call(path, "betweennessCentrality") == [(1, 0.0), (2, 0.5), (3, 0.0)]
    assert call(path, "closenessCentrality") == [(1, 2 / 3), (2, 0.25), (3, 0.0)]
    assert call(path, "degreeCentrality") == [(1, 0, 1, 1, 0.5), (2, 1, 1, 2, 1.0), (3, 1, 0, 1, 0.5)]


def test_triangles_and_similarity(spark):
    g = graph(spark, 4, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert call(g, "triangleCount") == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1 / 3), (4, 0, 0.0)]
    assert call(g, "triangleCount", mode="global") == [(1, 0.6)]
    g = graph(spark, 4, [(1, 3), (1, 4), (2, 3), (2, 4)])
    assert call(g, "jaccardSimilarity", node=1) == [(1, 2, 1.0)]


@pytest.mark.parametrize("name", ["labelPropagation", "louvain", "leiden"])
def test_communities(spark, name):
    got = dict(call(graph(spark, 7, CLIQUES), name))
    assert {got[1], got[2], got[3]} == {1} and {got[4], got[5], got[6]} == {4} and got[7] == 7


def test_weighted_cliques(spark):
    edges = [(a, b, 10) for a, b in CLIQUES] + [(3, 4, 0.1)]
    got = dict(call(graph(spark, 6, edges), "louvain", weight="w"))
    assert got[1] == got[3] != got[4] == got[6]


def test_flow(spark):
    g = graph(spark, 4, [(1, 2, 3), (2, 4, 2), (1, 3, 5), (3, 4, 4), (2, 3, 9)])
    assert call(g, "maxFlow", source=1, sink=4, capacity="w") == [(1, 4, 6.0)]
    with pytest.raises(GraphError):
        call(g, "maxFlow", source=1, sink=1)
    assert call(graph(spark, 2, [(1, 2)]), "maxFlow", source=2, sink=1, capacity="w") == [(2, 1, 0.0)]


def test_empty(spark):
    g = PropertyGraph(spark)
    for name in ("wcc", "scc", "pageRank", "betweennessCentrality", "closenessCentrality", "degreeCentrality", "triangleCount", "labelPropagation", "louvain"):
        assert call(g, name) == []
    assert call(g, "triangleCount", mode="global") == [(0, 0.0)]


def random_graph(spark, directed=True):
    """60 nodes, parallel edges and loops among them, a node without edges and a bridge to a cycle."""
    pick = random.Random(5)
    edges = [(pick.randint(1, 40), pick.randint(1, 40)) for _ in range(120)] + [(7, 50)] + [(i, i + 1) for i in range(50, 59)] + [(59, 50)]
    return graph(spark, 60, edges, directed), edges


def small_blocks(spark, monkeypatch):
    """No worker may keep an adjacency and the driver may not collect one."""
    monkeypatch.setattr(blocks, "HELD", 0)
    monkeypatch.setattr(blocks, "FILE_ROWS", 16)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda df: pytest.fail("the graph went to the driver"))


def depths(edges, s):
    dist, level = {s: 0}, [s]
    while level:
        level = [w for w in {b for a, b in edges if a in level} if w not in dist]
        dist |= {w: max(dist.values()) + 1 for w in level}
    return dist


def test_closeness_in_blocks(spark, monkeypatch):
    g, edges = random_graph(spark)
    kept = call(g, "closenessCentrality", wfImproved=False)
    small_blocks(spark, monkeypatch)
    assert call(g, "closenessCentrality", wfImproved=False) == kept
    for node, score in kept:
        d = depths(edges, node)
        assert score == ((len(d) - 1) / sum(d.values()) if len(d) > 1 else 0.0)


def brandes(edges, n):
    """Betweenness by the definition: shares of shortest paths, each parallel edge a path of its own."""
    paths = {}  # number of shortest paths and their length
    for s in range(1, n + 1):
        d = depths(edges, s)
        count = {s: 1}
        for v in sorted(d, key=d.get)[1:]:
            count[v] = sum(count[a] for a, b in edges if b == v and a in d and d[a] == d[v] - 1)
        paths[s] = (d, count)
    score = dict.fromkeys(range(1, n + 1), 0.0)
    for s, (d, count) in paths.items():
        for v in d:
            dv, cv = paths[v]
            for t in dv:
                if s != v != t != s and d[v] + dv[t] == d[t]:
                    score[v] += count[v] * cv[t] / count[t]
    return score


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_in_blocks(spark, monkeypatch, directed):
    g, edges = random_graph(spark, directed)
    both = edges if directed else edges + [(b, a) for a, b in edges if a != b]
    want = brandes([e for e in both if e[0] != e[1]], 60)
    kept = dict(call(g, "betweennessCentrality", normalized=False, directed=directed))
    assert all(abs(kept[v] - want[v]) < 1e-9 for v in want)
    small_blocks(spark, monkeypatch)
    read = dict(call(g, "betweennessCentrality", normalized=False, directed=directed))
    by_weight = dict(call(g, "betweennessCentrality", normalized=False, directed=directed, weight="w"))
    assert all(abs(read[v] - want[v]) < 1e-9 and abs(by_weight[v] - want[v]) < 1e-9 for v in want)


def test_betweenness_shares_memory(monkeypatch, spark):
    """Sources whose paths don't fit together are halved."""
    g, edges = random_graph(spark)
    adj = spark.createDataFrame([e for e in edges if e[0] != e[1]], "node long, nbr long")
    out, into = blocks.Blocks(adj, 61), blocks.Blocks(adj.select(adj.nbr.alias("node"), adj.node.alias("nbr")), 61)
    args = out, into, (out.degrees(), into.degrees()), np.arange(61)
    want = blocks.all_dependencies(*args)
    monkeypatch.setattr(blocks, "PATHS", 10)
    monkeypatch.setattr(blocks, "STEP", 3)
    with pytest.raises(blocks.TooMany):
        blocks.dependencies(*args)
    assert np.allclose(blocks.all_dependencies(*args), want)


@pytest.mark.parametrize("method", ["jaccard", "overlap", "commonNeighbors"])
@pytest.mark.parametrize("direction", ["any", "out", "in"])
def test_similarity_in_blocks(spark, monkeypatch, method, direction):
    g, edges = random_graph(spark)
    arcs = {(a, b) for a, b in edges if a != b}
    arcs = {"out": arcs, "in": {(b, a) for a, b in arcs}, "any": arcs | {(b, a) for a, b in arcs}}[direction]
    near = {v: {b for a, b in arcs if a == v} for v, _ in arcs}
    score = {"jaccard": lambda x, y: len(x & y) / len(x | y), "overlap": lambda x, y: len(x & y) / min(len(x), len(y)), "commonNeighbors": lambda x, y: float(len(x & y))}[method]
    want = []
    for v in near:
        best = sorted((-score(near[v], near[w]), w) for w in near if w != v and near[v] & near[w])[:3]
        want += [(v, w, -x) for x, w in best]
    assert call(g, "jaccardSimilarity", topK=3, method=method, direction=direction) == sorted(want)
    small_blocks(spark, monkeypatch)
    assert call(g, "jaccardSimilarity", topK=3, method=method, direction=direction) == sorted(want)
    assert call(g, "jaccardSimilarity", topK=3, method=method, direction=direction, node=7) == sorted(x for x in want if x[0] == 7)
    assert call(g, "jaccardSimilarity", node=99) == []


def test_similarity_writes_no_pairs(spark):
    """3000 nodes about two hubs: nine million pairs share a hub, none of them goes through a shuffle."""
    g = graph(spark, 3002, [(i, h) for i in range(1, 3001) for h in (3001, 3002)])
    df, _ = dispatch(g, "jaccardSimilarity", {"topK": 1})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInPandas" in plan
    got = {r["node1"]: (r["node2"], r["score"]) for r in df.collect()}
    assert len(got) == 3002 and got[1] == (2, 1.0) and got[5] == (1, 1.0) and got[3001] == (3002, 1.0)


def test_counts_over_steps(monkeypatch, spark):
    adj = spark.createDataFrame([(v, w) for v in range(40) for w in range(40) if (v * w) % 3 != 1 and v != w], "node long, nbr long")
    left = blocks.Blocks(adj, 40)
    args = left, left, left.degrees(), np.arange(3, 9), "jaccard", 5
    want = [[x.tolist() for x in r] for r in blocks.alike(*args)]
    monkeypatch.setattr(blocks, "STEP", 7)
    assert [[x.tolist() for x in r] for r in blocks.alike(*args)] == want


def cut(edges, s, t):
    """The least capacity over all cuts."""
    inner = sorted({v for a, b, _ in edges for v in (a, b)} - {s, t})
    sides = ({s} | {v for k, v in enumerate(inner) if m >> k & 1} for m in range(1 << len(inner)))
    return min(sum(w for a, b, w in edges if a in side and b not in side) for side in sides)


@pytest.mark.parametrize("directed", [True, False])
def test_flow_is_the_least_cut(spark, monkeypatch, directed):
    pick = random.Random(3)
    for seed in range(2):
        edges = [(pick.randint(1, 10), pick.randint(1, 10), pick.randint(1, 9) / 4) for _ in range(26 if seed else 18)]
        both = edges if directed else edges + [(b, a, w) for a, b, w in edges]
        g = graph(spark, 12, edges, directed)
        assert call(g, "maxFlow", source=1, sink=10, capacity="w") == [(1, 10, cut(both, 1, 10))]
        with monkeypatch.context() as m:
            small_blocks(spark, m)
            assert call(g, "maxFlow", source=1, sink=10, capacity="w") == [(1, 10, cut(both, 1, 10))]
    assert call(g, "maxFlow", source=1, sink=12, capacity="w") == [(1, 12, 0.0)]
    assert call(graph(spark, 3, []), "maxFlow", source=1, sink=2, capacity="w") == [(1, 2, 0.0)]


def test_flow_of_many_paths(spark):
    """20,000 paths side by side: one search for each would read 60,000 edges 20,000 times."""
    k = 20_000
    edges = [e for i in range(3, k + 3) for e in ((1, i, i % 7 + 1), (i, i + k, 3), (i + k, 2, 9))]
    want = float(sum(min(i % 7 + 1, 3) for i in range(3, k + 3)))
    began = time.monotonic()
    assert call(graph(spark, 2 * k + 2, edges), "maxFlow", source=1, sink=2, capacity="w") == [(1, 2, want)]
    assert time.monotonic() - began < 60
