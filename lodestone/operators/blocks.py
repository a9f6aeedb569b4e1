"""A graph's adjacency in sorted files, for kernels that read it block by block: the driver holds none of it, a worker
as much as HELD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lodestone.shared import materialize

#: Rows of a file, and bytes of one adjacency up to which a worker keeps it; beyond, files are read anew at each use.
FILE_ROWS, HELD = 1_000_000, 1 << 28
#: Edges that one step of a kernel takes at most, and edges on shortest paths that several sources may hold together.
STEP, PATHS = 1 << 20, 1 << 22

_held: dict[tuple, tuple] = {}


def release() -> None:
    """Let go of the adjacencies that this worker keeps."""
    _held.clear()


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(``node``, ``i``): numbers from 0 without gaps in the order of ids, and how many there are."""
    at = nodes.select("node").repartitionByRange("node").sortWithinPartitions("node")
    at = materialize(at.select("node", F.monotonically_increasing_id().alias("at")), "numbers")
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, at.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()))
    if not sizes:
        return at.select("node", F.col("at").alias("i")), 0
    firsts, n = [], 0
    for p, k in sizes:
        firsts.append((p, n))
        n += k
    first = nodes.sparkSession.createDataFrame(firsts, "part long, first long")
    out = at.withColumn("part", part).join(F.broadcast(first), "part")
    return out.select("node", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("i")), n


def renumber(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """(``node``, ``nbr``, ...) with numbers in the place of ids; edges of no node are left out."""
    rest = [c for c in adj.columns if c not in ("node", "nbr")]
    out = adj.join(ids.withColumnRenamed("i", "s"), "node").join(ids.toDF("nbr", "d"), "nbr")
    return materialize(out.select(F.col("s").alias("node"), F.col("d").alias("nbr"), *rest), "numbered")


class Blocks:
    """The rows of an adjacency by node number. Made on the driver from a table of numbers; workers read the files."""

    def __init__(self, adj: DataFrame, n: int):
        rows = adj.count()
        table = materialize(adj.repartitionByRange(max(1, -(-rows // FILE_ROWS)), "node").sortWithinPartitions("node"), "blocks")
        spans = table.groupBy(F.input_file_name().alias("f")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
        self.n, self.rows = n, rows
        self.files = sorted((int(low), int(high) + 1, f) for f, low, high in spans.collect())
        self.held = rows * 8 * (len(adj.columns) - 1) + n * 8 <= HELD

    def read(self, low: int, high: int, file: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None]:
        """(first number, starts, neighbours, weights) of a file."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            got = pq.read_table(f)
        node = got["node"].to_numpy()
        starts = np.searchsorted(node, np.arange(low, high + 1))
        return low, starts, got["nbr"].to_numpy(), got["w"].to_numpy() if "w" in got.column_names else None

    def __iter__(self) -> Iterator[tuple]:
        """All blocks in order; one, if the worker may keep the whole."""
        yield from self.within(0, self.n)

    def within(self, low: int, high: int) -> Iterator[tuple]:
        """The blocks that may have rows of numbers from ``low`` to below ``high``."""
        if not self.held:
            for a, b, f in self.files:
                if a < high and b > low:
                    yield self.read(a, b, f)
        elif self.files:
            key = tuple(f for _, _, f in self.files)
            if key not in _held:
                while len(_held) > 1:  # of earlier statements
                    _held.pop(next(iter(_held)))
                parts = [self.read(*x) for x in self.files]
                counts = np.zeros(self.n, np.int64)
                for a, starts, _, _ in parts:
                    counts[a : a + len(starts) - 1] = np.diff(starts)
                starts = np.concatenate([[0], np.cumsum(counts)])
                ws = None if parts[0][3] is None else np.concatenate([p[3] for p in parts])
                _held[key] = (0, starts, np.concatenate([p[2] for p in parts]), ws)
            yield _held[key]

    def degrees(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for low, starts, _, _ in self:
            out[low : low + len(starts) - 1] = np.diff(starts)
        return out

    def expand(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """For the rows of ``nodes``: (place in ``nodes``, neighbour, weight), at most about STEP at a time."""
        if not len(nodes):
            return
        for low, starts, nbrs, ws in self.within(int(nodes.min()), int(nodes.max()) + 1):
            place = None if low == 0 and len(starts) > self.n else np.flatnonzero((nodes >= low) & (nodes < low + len(starts) - 1))
            own = (nodes if place is None else nodes[place]) - low
            first = starts[own]
            count = starts[own + 1] - first
            ends = np.cumsum(count)
            a = done = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, done + STEP, "right")))
                k = count[a:b]
                total = int(ends[b - 1]) - done
                if total:
                    at = np.repeat(first[a:b] - (ends[a:b] - k) + done, k)
                    at += np.arange(total)
                    which = np.repeat(np.arange(a, b) if place is None else place[a:b], k)
                    for c in range(0, total, STEP):  # one row may be longer than a step
                        e = at[c : c + STEP]
                        yield which[c : c + STEP], nbrs[e], None if ws is None else ws[e]
                a, done = b, int(ends[b - 1])

    def row(self, v: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Neighbours and weights of one number."""
        for low, starts, nbrs, ws in self.within(v, v + 1):
            if low <= v < low + len(starts) - 1:
                s = slice(starts[v - low], starts[v - low + 1])
                return nbrs[s], None if ws is None else ws[s]
        return np.zeros(0, np.int64), np.zeros(0)


def distances(into: Blocks, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many other nodes each source reaches, and the sum of their distances: breadth-first search of all sources at
    once, a bit for each. ``into`` has the nodes before each node."""
    n, words = into.n, -(-len(sources) // 64)
    found, total = np.zeros(words * 64, np.int64), np.zeros(words * 64, np.int64)
    bit = np.arange(len(sources))
    front, new, seen = (np.zeros((n, words), np.uint64) for _ in range(3))
    front[sources, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    seen |= front
    full = np.bitwise_or.reduce(front, axis=0)
    active, depth, step = front.any(axis=1), 0, max(1, STEP // words)
    while active.any():
        depth += 1
        new[:] = 0
        still = (seen != full).any(axis=1)
        for low, starts, nbrs, _ in into:
            degree = np.diff(starts)
            at = np.flatnonzero(active[nbrs] & np.repeat(still[low : low + len(degree)], degree))
            if not len(at):
                continue
            row, before = np.repeat(np.arange(low, low + len(degree)), degree)[at], nbrs[at]
            for a in range(0, len(at), step):
                r = row[a : a + step]
                cut = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
                new[r[cut]] |= np.bitwise_or.reduceat(front[before[a : a + step]], cut, axis=0)
        new &= ~seen
        seen |= new
        active = new.any(axis=1)
        rows, count = np.flatnonzero(active), np.zeros(words * 64, np.int64)
        for a in range(0, len(rows), 255):  # so many sum up in a byte
            bits = np.unpackbits(new[rows[a : a + 255]].astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
            count += bits.sum(axis=0, dtype=np.uint8)
        found, total = found + count, total + depth * count
        front, new = new, front
    return found[: len(sources)], total[: len(sources)]


class TooMany(Exception):
    """The shortest paths of several sources take more memory than a kernel should."""


def sums(at: np.ndarray, value: np.ndarray, total: np.ndarray) -> None:
    """Add each value at its place of ``total``."""
    if len(at) > len(total) // 8:
        total += np.bincount(at, value, len(total))
    else:
        np.add.at(total, at, value)


def dependencies(out: Blocks, into: Blocks, degrees: tuple[np.ndarray, np.ndarray], sources: np.ndarray) -> np.ndarray:
    """Brandes' dependencies of the nodes, summed over ``sources``, by hops. All sources go level by level together, each
    with its own keys (place of the source * n + node); a level takes the edges out of it or those into what is not yet
    reached, whichever are fewer."""
    n, k = out.n, len(sources)
    size = n * k
    start = np.arange(k) * n + sources
    state, place = np.zeros(size, np.uint8), np.zeros(size, np.int64)  # 0: not reached, 1: reached, 2: the last level
    sigma = np.zeros(size)
    state[start], sigma[start] = 2, 1
    front, levels, held = start, [], 0
    while True:
        node, pull = front % n if k > 1 else front, False
        rows, edges = front, int(degrees[0][node].sum())
        if edges > size // 4:
            left = np.flatnonzero(state == 0)
            low = left % n if k > 1 else left
            if int(degrees[1][low].sum()) < edges:
                rows, node, pull = left, low, True
        base, found = rows - node, []
        for which, nbr, _ in (into if pull else out).expand(node):
            end = base[which] + nbr if k > 1 else nbr
            keep = state[end] == (2 if pull else 0)
            found.append((which[keep], end[keep]))
            held += len(found[-1][1])
            if held > PATHS and k > 1:
                raise TooMany
        which, end = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0] if found else (front[:0], front[:0])
        if not len(end):
            break
        if pull:
            got = np.bincount(which, sigma[end], len(rows))
            sigma[rows] += got
            after = rows[got > 0]
            state[front] = 1
            state[after] = 2
        else:
            sums(end, sigma[front][which], sigma)
            state[front] = 1
            state[end] = 2
            if len(end) > size // 8:
                after = np.flatnonzero(state == 2)
            else:
                order = np.arange(len(end))
                place[end] = order
                after = end[place[end] == order]  # each once
        levels.append((pull, rows, which, end, after))
        front = after
    delta, share = np.zeros(size), np.zeros(size)
    while levels:  # share: (1 + dependency) / paths, of the later level
        pull, rows, which, end, after = levels.pop()
        delta[after] *= sigma[after]
        share[after] = (1 + delta[after]) / sigma[after]
        if pull:
            sums(end, share[rows][which], delta)
        else:
            delta[rows] += np.bincount(which, share[end], len(rows))
    delta[start] = 0
    return delta.reshape(k, n).sum(axis=0)


def all_dependencies(out: Blocks, into: Blocks, degrees: tuple[np.ndarray, np.ndarray], sources: np.ndarray) -> np.ndarray:
    try:
        return dependencies(out, into, degrees, sources)
    except TooMany:
        half = len(sources) // 2
        return all_dependencies(out, into, degrees, sources[:half]) + all_dependencies(out, into, degrees, sources[half:])


def weighted_dependencies(out: Blocks, s: int) -> np.ndarray:
    """Those of one source by Dijkstra's order; a negative weight counts as zero."""
    from heapq import heappop, heappush

    n = out.n
    score, sigma, dist, done = np.zeros(n), np.zeros(n), np.full(n, np.inf), np.zeros(n, bool)
    preds, order, heap = {s: []}, [], [(0.0, s)]
    sigma[s], dist[s] = 1, 0
    while heap:
        d, v = heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        nbrs, weights = out.row(v)
        for w, x in zip(nbrs.tolist(), weights.tolist()):
            new = d + max(x, 0.0)
            if new < dist[w]:
                dist[w], sigma[w], preds[w] = new, sigma[v], [v]
                heappush(heap, (new, w))
            elif new == dist[w] and not done[w] and w != s:
                sigma[w] += sigma[v]
                preds[w].append(v)
    for w in reversed(order):
        for v in preds[w]:
            score[v] += sigma[v] / sigma[w] * (1 + score[w])
    score[s] = 0
    return score


def counted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys (below ``size``), ascending, and how often each stands."""
    if size > max(8 * len(keys), 1 << 16):
        return np.unique(keys, return_counts=True)
    count = np.bincount(keys, minlength=size)
    found = np.flatnonzero(count)
    return found, count[found]


def alike(left: Blocks, right: Blocks, degree: np.ndarray, rows: np.ndarray, method: str, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(number, number, score) of the ``top`` other rows of ``left`` that share most neighbours with each of ``rows``, equal
    scores by number. ``right`` has the rows by neighbour."""
    n, base = left.n, int(rows[0])
    which, nbr = (np.concatenate(x) for x in zip(*[(w, m) for w, m, _ in left.expand(rows)], (rows[:0], rows[:0])))
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    for entry, other, _ in right.expand(nbr):  # a step at a time: what a row shares is summed up over steps
        merged.append(counted(which[entry] * n + other, len(rows) * n))
        if len(merged) > 1 and sum(len(k) for k, _ in merged) > 4 * STEP:
            merged = [merge(merged)]
    keys, count = merge(merged) if merged else (rows[:0], rows[:0])
    row, other = np.divmod(keys, n)
    keep = row + base != other
    row, other, c = row[keep], other[keep], count[keep].astype(float)
    d1, d2 = degree[row + base], degree[other]
    score = c / (d1 + d2 - c) if method == "jaccard" else c / np.minimum(d1, d2) if method == "overlap" else c
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b > a:
            own = score[a:b]
            some = np.arange(b - a) if b - a <= top else np.flatnonzero(own >= np.partition(own, b - a - top)[b - a - top])
            some = some[np.lexsort((other[a:b][some], -own[some]))][:top]
            yield row[a:b][some] + base, other[a:b][some], own[some]


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
