"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import FloatType

from lodestone.llm.simhash import Forest
from lodestone.operators.components import connected_components
from lodestone.shared import forget, materialize

THRESHOLD = 0.9
#: Random directions; where the windows of a sorted projection begin, in deviations from its middle; half a window, in
#: deviations of the difference of a pair right at the threshold; the chance that such a pair is lost, at most.
DIRECTIONS, START, REACH, LOSS, SEED = 12_000, 3.0, 2.0, 1e-4, 97
#: Steps of a deviation in which projections are kept; rows of a task; members of a window that are counted as one matrix.
STEPS, ROWS, DENSE, TILE = 256, 200_000, 1024, 1024


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def _below(n: int, p: float, k: int) -> float:
    """P(X < k) for a binomial X."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def reach(threshold: float = THRESHOLD) -> float:
    """Half a window, in deviations of a projection."""
    return REACH * math.sqrt(2 - 2 * threshold)


def calibrate(threshold: float = THRESHOLD) -> int:
    """Least collisions of a pair.

    Directions are standard normal and independent, so the projections of two unit vectors of cosine t are
    normal with the correlation t. They collide on a direction if both lie beyond START at the same end and
    within the window around the other; the chance follows by integrating the one value and the count of
    collisions is binomial. Of all counts that lose a pair right at the threshold with a chance of LOSS at most the
    largest is taken; pairs closer together collide more."""
    x, s = np.linspace(START, START + 6, 4001), math.sqrt(max(1e-12, 1 - threshold**2))
    high, low = (x + reach(threshold) - threshold * x) / s, (np.maximum(START, x - reach(threshold)) - threshold * x) / s
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.clip(_normal(high) - _normal(low), 0, None)
    p = 2 * float(density.sum() * (x[1] - x[0])) * 0.99  # both ends; a little less for the steps
    return max([k for k in range(1, 20) if _below(DIRECTIONS, p, k) <= LOSS], default=1)


@cache
def directions(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, DIRECTIONS), dtype=np.float32)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signature(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, value) of every projection beyond START, by row and list. An end of a direction is one
    sorted list: 2 d the upper end of direction d, 2 d + 1 the lower, its values mirrored."""
    p = unit.astype(np.float32) @ directions(unit.shape[1])
    row, d = np.nonzero(np.abs(p) >= np.float32(START))
    value = p[row, d]
    return row, (2 * d + (value < 0)).astype(np.int16), np.minimum(np.abs(value) * STEPS, 32767).astype(np.int16)


def windows(members: np.ndarray, path: list[int], lists: np.ndarray, draw: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows out of ``members``, all in the first list of ``path``, that are in at least ``least`` common lists. A pair comes
    from one list only, drawn from those in common by what ``draw`` (a random number of each row) adds up to, so that the
    pairs of a hot group spread over its lists; and from one path only, as the others on it are the first in common.

    ``lists`` (ascending, padded by -1) tells all lists that a row is in. Where more than DENSE rows are members, each
    further list that several of them are in splits them, until the path is as long as the count asks for; then, and where there
    are fewer, products of membership matrices count, tile by tile, what each pair has in common."""
    own, first, last = lists[members], path[0], path[-1] if len(path) > 1 else -1
    order = np.argsort(own.ravel(), kind="stable")
    flat, row = own.ravel()[order], order // own.shape[1]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    ids, size = flat[start], np.diff(np.append(start, len(flat)))
    shared = (size >= 2) & (ids >= 0) & ~np.isin(ids, path)
    if len(members) > DENSE and len(path) < least:
        for k in np.flatnonzero(shared & (ids > last)):
            yield from windows(members[row[start[k] : start[k] + size[k]]], [*path, int(ids[k])], lists, draw, least)
        return
    row, ids, column = row[np.repeat(shared, size)], ids[shared], np.repeat(np.arange(shared.sum()), size[shared])
    some = np.bincount(row, minlength=len(members)) >= least - len(path)
    row, column, members = (np.cumsum(some) - 1)[row[some[row]]], column[some[row]], members[some]
    low, before = int(np.searchsorted(ids, last)), int(np.searchsorted(ids, first))
    ahead = sum(k < first for k in path[1:])

    def matrix(a: int) -> np.ndarray:
        out, here = np.zeros((min(TILE, len(members) - a), len(ids)), np.float32), (row >= a) & (row < a + TILE)
        out[row[here] - a, column[here]] = 1
        return out

    for a in range(0, len(members), TILE):
        x = matrix(a)
        for b in range(a, len(members), TILE):
            y = x if a == b else matrix(b)
            common = x[:, low:] @ y[:, low:].T
            good = common >= least - len(path)
            if low:
                good &= x[:, :low] @ y[:, :low].T == 0
            i, j = np.nonzero(np.triu(good, 1) if a == b else good)
            if not len(i):
                continue
            rank = (x[:, low:before] @ y[:, low:before].T)[i, j] if before > low else np.zeros(len(i))
            drawn = ((draw[members[a + i]] + draw[members[b + j]]) >> np.uint64(33)) % (common[i, j] + len(path)).astype(np.uint64)
            mine = drawn == (rank + ahead).astype(np.uint64)
            yield members[a + i[mine]], members[b + j[mine]]


def coded(lists: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A number of each list and value, in which those of one list lie as far apart as the values and others farther than any window."""
    return lists.astype(np.int32) * 16384 + np.minimum(values, 16383)


def collisions(i: np.ndarray, j: np.ndarray, codes: np.ndarray, width: int, enough: int) -> np.ndarray:
    """How often each pair collides: lists that both are in, with the one's value in the window around the other's. Not
    counted on where ``enough`` are found."""
    out = np.empty(len(i), np.int64)
    for c in range(0, len(i), 2048):
        x, y = codes[i[c : c + 2048]], codes[j[c : c + 2048]]
        x = np.where(x < 0, -(1 << 29), x)  # the padding of both must not meet
        n = (np.abs(x[:, :8, None] - y[:, None, :]) <= width).sum(axis=(1, 2))
        rest = np.flatnonzero(n < enough)
        n[rest] += (np.abs(x[rest, 8:, None] - y[rest, None, :]) <= width).sum(axis=(1, 2))
        out[c : c + 2048] = n
    return out


def near_embeddings(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``) of each row.

    Rows whose cosine (double precision) is ``threshold`` or more are linked. Equal vectors are one class
    from the start. Each class is projected on DIRECTIONS; a projection, sorted, has query-centred windows at its two ends
    only, where vectors are sparse (in its middle a window as wide as a link needs holds a quarter of all vectors and
    tells next to nothing). So a class is in about 32 of 24,000 lists, and is sent, with what lists it is in, to the tasks that
    hold them, each a range of lists. A task counts collisions of the pairs in its lists, verifies those that reach the
    calibrated count by their cosine, each pair in one list drawn from those it has in common, and returns a
    row for each class (how many vectors it links to) and the edges of a spanning forest instead of
    all pairs. A list of more than ROWS classes is met block by block, so no list is gathered in one task and none is cut.

    Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with
    nothing: n_links 0, its own component; vectors of different lengths don't link; a pair right at the threshold is a link; a null
    id takes part as a vector but names no component; repeated rows count as vectors each; no rows give no rows; very long
    vectors cost DIRECTIONS products a component; other columns are not read, whatever their names.
    """
    least, width = calibrate(threshold), int(reach(threshold) * STEPS) + 1
    single = isinstance(rows.schema[vec_col].dataType.elementType, FloatType)
    kind, dtype = ("float", np.float32) if single else ("double", np.float64)
    vec = F.transform(F.col(vec_col), lambda x: x.cast(kind))
    ok = F.coalesce(
        (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0.0), F.lit(False)
    )
    rows = rows.select(F.col(id_col), F.when(ok, F.transform(vec, lambda x: x + F.lit(0.0).cast(kind))).alias("_v"))
    rows = materialize(rows.withColumn("_class", F.when(F.col("_v").isNotNull(), F.sha2(F.concat_ws(",", F.col("_v").cast("array<string>")), 256))), "emb-rows")
    classes = rows.where("_class is not null").groupBy("_class").agg(F.count(F.lit(1)).alias("many"), F.min(id_col).alias("least"), F.first("_v").alias("v"))
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "emb-classes")
    n = classes.count()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["v"].map(len).to_numpy()
            for dim in np.unique(length):
                own = batch[length == dim]
                for a in range(0, len(own), 1024):
                    some = own.iloc[a : a + 1024]
                    x = np.stack(some["v"].to_list()).astype(dtype)
                    row, lists, values = signature(units(x))
                    cuts = np.searchsorted(row, np.arange(len(x) + 1))
                    cut = lambda flat: [flat[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])]  # noqa: E731, B023
                    yield pd.DataFrame({"no": some["no"], "many": some["many"], "dim": dim, "v": [r.tobytes() for r in x], "lists": cut(lists), "places": cut(values)})

    signed = classes.select("no", "many", "v").repartition(max(16, math.ceil(n / 20_000)), "no").mapInPandas(sign, "no long, many long, dim int, v binary, lists binary, places binary")
    signed = materialize(signed, "emb-signed")
    ends = 2 * DIRECTIONS
    groups = max(8, math.ceil(32 * n / ROWS))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [np.frombuffer(x, np.int16) for x in batch["lists"]]
            found = pd.DataFrame({"dim": np.repeat(batch["dim"], [len(x) for x in lists]), "list": np.concatenate([*lists, np.zeros(0, np.int16)]).astype(int)})
            yield found.groupby(["dim", "list"]).size().rename("n").reset_index()

    dense = {}
    if n > ROWS:  # no list holds more rows than there are; otherwise at most 32 n / ROWS lists are dense
        sizes = signed.select("dim", "lists").mapInPandas(members, "dim int, list int, n long").groupBy("dim", "list").agg(F.sum("n").alias("n"))
        dense = {(r["dim"], r["list"]): math.ceil(2 * r["n"] / ROWS) for r in sizes.where(F.col("n") > ROWS).collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, key = [], []
            for i, (no, dim, flat) in enumerate(zip(batch["no"], batch["dim"], batch["lists"])):
                lists = np.frombuffer(flat, np.int16).astype(np.int64)
                hot = [k for k in lists.tolist() if (dim, k) in dense] if dense else []
                to = [(-1, g, g, g) for g in np.unique(np.setdiff1d(lists, hot) * groups // ends).tolist()]
                for k in hot:
                    home = hash((no, k)) % dense[dim, k]
                    to += [(k, min(home, b), max(home, b), home) for b in range(dense[dim, k])]
                at += [i] * len(to)
                key += to
            yield pd.concat([pd.DataFrame(key, columns=["list", "a", "b", "home"], dtype=np.int64), batch.iloc[at].reset_index(drop=True)], axis=1)

    def meet(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        dim, hot, part, other = (int(k) for k in key)
        no, many, home = found["no"].to_numpy(), found["many"].to_numpy(), found["home"].to_numpy()
        unit = units(np.frombuffer(b"".join(found["v"]), dtype=dtype).reshape(len(found), dim))
        size = found["lists"].map(len).to_numpy() // 2
        flat, row = np.frombuffer(b"".join(found["lists"]), np.int16), np.repeat(np.arange(len(found)), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        lists, values = np.full((len(found), max(1, size.max())), -1, np.int16), np.zeros((len(found), max(1, size.max())), np.int16)
        lists[row, column], values[row, column] = flat, np.frombuffer(b"".join(found["places"]), np.int16)
        codes, draw = coded(lists, values), pd.util.hash_array(no)
        own = flat == hot if hot >= 0 else (flat.astype(np.int64) * groups // ends == part) & ~np.isin(flat, [k for d, k in dense if d == dim])
        row, flat = row[own], flat[own]
        order = np.argsort(flat, kind="stable")
        row, flat = row[order], flat[order]
        k, start, length = np.unique(flat, return_index=True, return_counts=True)
        links, forest = np.zeros(len(found), np.int64), Forest(len(found))
        for k, s, m in zip(k.tolist(), start.tolist(), length.tolist()):
            if m < 2:
                continue
            for i, j in windows(row[s : s + m], [k], lists, draw, least):
                if part != other:
                    cross = home[i] != home[j]
                    i, j = i[cross], j[cross]
                for c in range(0, len(i), 1 << 16):
                    x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    often = collisions(x, y, codes, width, least) >= least
                    x, y = x[often], y[often]
                    near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    x, y = x[near], y[near]
                    if len(x):
                        np.add.at(links, x, many[y])
                        np.add.at(links, y, many[x])
                        forest.add(x, y)
        some = np.flatnonzero(links)
        return pd.DataFrame({"no": no[some], "links": links[some], "to": no[forest.parent[some]]})

    sent = signed.mapInPandas(deal, "list int, a int, b int, home int, no long, many long, dim int, v binary, lists binary, places binary")
    found = materialize(sent.groupBy("dim", "list", "a", "b").applyInPandas(meet, "no long, links long, to long"), "emb-links")
    forget(signed)
    parts_of = connected_components(found.select(F.col("no").alias("src"), F.col("to").alias("dst")))
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    known = classes.select("_class", "no", "many", "least").join(links, "no", "left").join(parts_of.withColumnRenamed("node", "no"), "no", "left")
    known = known.withColumn("component", F.coalesce("component", "no"))
    least_of = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least_of, "component").select("_class", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), "component_id")
    out = rows.select(id_col, "_class").join(materialize(known, "emb-known"), "_class", "left")
    component = F.when(F.col("_class").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(id_col, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(id_col) == component, F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
    l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
    r(s, d) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, l.d FROM r JOIN l ON r.d = l.s)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT s AS vec_id, min(d) AS c FROM r GROUP BY s) LEFT JOIN (SELECT s AS vec_id, count(*) AS n FROM l GROUP BY s) USING (vec_id)
"""
}
