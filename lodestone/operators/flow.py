"""Maximum flow over the blocks of a graph."""

from __future__ import annotations

import numpy as np

from lodestone.operators.blocks import Blocks, release

#: What is left of a capacity after float arithmetic counts as nothing up to here.
EPS = 1e-12


def reached(out: Blocks, start: int) -> np.ndarray:
    seen = np.zeros(out.n, bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        new = np.zeros(out.n, bool)
        for _, nbr, _ in out.expand(front):
            new[nbr] = True
        new &= ~seen
        seen |= new
        front = np.flatnonzero(new)
    return seen


class Residual:
    """Edges and their reverses, sorted by their first end: ``back`` names the reverse of each, ``left`` what it still takes."""

    def __init__(self, u: np.ndarray, v: np.ndarray, capacity: np.ndarray, n: int):
        m = len(u)
        tail = np.concatenate([u, v])
        order = np.argsort(tail, kind="stable")
        place = np.empty(2 * m, np.int64)
        place[order] = np.arange(2 * m)
        self.n, self.tail, self.head = n, tail[order], np.concatenate([v, u])[order]
        self.left = np.concatenate([capacity, np.zeros(m)])[order]
        self.back = place[(order + m) % (2 * m)]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n))])

    def edges_of(self, nodes: np.ndarray) -> np.ndarray:
        first = self.starts[nodes]
        count = self.starts[nodes + 1] - first
        return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())

    def shortest(self, source: int, sink: int) -> np.ndarray:
        """The edges with something left on all shortest paths from source to sink."""
        level = np.full(self.n, -1, np.int64)
        level[source], front, depth = 0, np.array([source]), 0
        while level[sink] < 0 and len(front):
            depth += 1
            e = self.edges_of(front)
            to = self.head[e[self.left[e] > EPS]]
            front = np.unique(to[level[to] < 0])
            level[front] = depth
        found, front = [np.zeros(0, np.int64)], np.array([sink] if level[sink] > 0 else [], np.int64)
        while len(front) and level[front[0]] > 0:
            e = self.back[self.edges_of(front)]
            e = e[(self.left[e] > EPS) & (level[self.tail[e]] == level[front[0]] - 1)]
            found.append(e)
            front = np.unique(self.tail[e])
        return np.concatenate(found)

    def saturate(self, edges: np.ndarray, source: int, sink: int) -> float:
        """Push along ``edges`` until each path over them has a full edge; each edge is left behind once."""
        ways: dict[int, list[int]] = {}
        for e, u in zip(edges.tolist(), self.tail[edges].tolist()):
            ways.setdefault(u, []).append(e)
        head = dict(zip(edges.tolist(), self.head[edges].tolist()))
        tail = dict(zip(edges.tolist(), self.tail[edges].tolist()))
        left = dict(zip(edges.tolist(), self.left[edges].tolist()))
        path, at, flow = [], source, 0.0
        while True:
            if at == sink:
                push = min(left[e] for e in path)
                flow += push
                for e in path:
                    left[e] -= push
                full = next(k for k, e in enumerate(path) if left[e] <= EPS)
                at = tail[path[full]]
                del path[full:]
            own = ways.get(at, [])
            while own and left[own[-1]] <= EPS:
                own.pop()
            if own:
                path.append(own[-1])
                at = head[own[-1]]
            elif path:
                at = tail[path.pop()]
                ways[at].pop()
            else:
                break
        now = np.array([left[e] for e in edges.tolist()])
        self.left[self.back[edges]] += self.left[edges] - now
        self.left[edges] = now
        return flow


def maximum_flow(out: Blocks, into: Blocks, source: int, sink: int) -> float:
    """Dinic over the nodes that the source reaches and that reach the sink."""
    between = reached(out, source) & reached(into, sink)
    if not between[source]:
        return 0.0
    parts = []
    for low, starts, nbrs, ws in out:
        degree = np.diff(starts)
        keep = np.flatnonzero(np.repeat(between[low : low + len(degree)], degree) & between[nbrs])
        parts.append((np.repeat(np.arange(low, low + len(degree)), degree)[keep], nbrs[keep], ws[keep]))
    release()
    u, v, w = (np.concatenate(x) for x in zip(*parts))
    del parts
    number = (np.cumsum(between) - 1).astype(np.int32 if out.n < 1 << 31 else np.int64)
    source, sink = int(number[source]), int(number[sink])
    graph, flow = Residual(number[u], number[v], w, int(between.sum())), 0.0
    while True:
        edges = graph.shortest(source, sink)
        if not len(edges):
            return flow
        flow += graph.saturate(edges, source, sink)
