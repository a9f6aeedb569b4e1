"""SimHash near-duplicates through vantage-point trees over Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.joins import fresh
from lodestone.operators.components import connected_components
from lodestone.shared import materialize

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints that a shard aims at, and a leaf of the tree within it; sampled fingerprints for each
#: shard from which the shards' tree is built, and shards at most.
SHARD, LEAF, PER_SHARD, MOST_SHARDS = 40_000, 128, 64, 1 << 15
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half the XXH64 (seed 42) of the word shingles, repeats counted.

    A-Z is lower-cased, words are what white space (U+0020, U+0009 to U+000D) parts. Fewer words than a
    shingle has: the whole sequence is the one shingle. No words or null: zero."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    counts, digest, join = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, PIECE):
        part = tokens[at : at + PIECE + words - 1]
        grams = zip(*[part[i:] for i in range(words)]) if len(part) >= words else [part]
        h = np.array([digest(join(g), SEED) for g in grams], dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(``id_col``, ``carry`` columns, ``fp``) of each row; ``fp`` is the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col), *carry, fp(F.col(text_col)).alias("fp"))


@dataclass
class Node:
    """Fingerprints at most ``mu`` from ``point`` are inside, the others outside. A leaf has a ``shard``
    (tree of shards) or its members' places (tree within a shard)."""

    point: np.uint64 = np.uint64(0)
    mu: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1
    members: np.ndarray | None = None


def build(fps: np.ndarray, leaf: int, members: np.ndarray | None = None, depth: int = 64) -> Node:
    """A vantage-point tree of distinct fingerprints. The point with the widest spread of distances out of
    a few is the vantage point; the radius is the median distance."""
    members = np.arange(len(fps)) if members is None else members
    if len(members) <= leaf or depth == 0:
        return Node(members=members)
    own, best = fps[members], None
    for i in np.linspace(0, len(own) - 1, 5).astype(int):
        d = np.bitwise_count(own ^ own[i])
        mu = int(np.median(d))
        if (d > mu).any() and (best is None or d.std() > best[0]):
            best = (d.std(), own[i], mu, d <= mu)
    if best is None:  # all as far from each of them: cut by the point itself
        d = np.bitwise_count(own ^ own[0])
        mu = int(d.min()) if d.min() < d.max() else -1
        if mu < 0:
            return Node(members=members)
        best = (0, own[0], mu, d <= mu)
    _, point, mu, inner = best
    return Node(point, mu, build(fps, leaf, members[inner], depth - 1), build(fps, leaf, members[~inner], depth - 1))


def route(tree: Node, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, shard, home?) for each fingerprint: its home shard, and each shard that it must visit.

    By the triangle inequality a fingerprint within ``radius`` of one at distance d from the vantage
    point is between d - radius and d + radius from it. Where homes are parted, those inside at more than
    mu - radius visit the other side, and find there all partners beyond the border; those outside
    needn't visit. A visitor goes wherever a partner may be."""
    out = []

    def down(node, at, home):
        if not len(at):
            return
        if node.inside is None:
            out.append((at, np.full(len(at), node.shard), home))
            return
        d = np.bitwise_count(fps[at] ^ node.point).astype(int)
        inner = d <= node.mu
        go_in = np.where(home, inner, d <= node.mu + radius)
        go_out = np.where(home, ~inner | (d > node.mu - radius), d > node.mu - radius)
        down(node.inside, at[go_in], home[go_in])
        down(node.outside, at[go_out], home[go_out] & ~inner[go_out])

    down(tree, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, bool))


def near_pairs(homes: np.ndarray, visitors: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in homes followed by visitors) of pairs within ``radius``: each pair of homes once, and each
    visitor with the homes near it. The tree of homes is walked by all queries of a node at once."""
    every = np.concatenate([homes, visitors])
    shards: list[Node] = []

    def number(node):
        if node.inside is None:
            node.shard = len(shards)
            shards.append(node)
        else:
            number(node.inside)
            number(node.outside)

    tree = build(homes, leaf)
    number(tree)
    n = len(homes)

    def down(node, at, home):
        if not len(at):
            return
        if node.inside is None:
            own = node.members
            for i in range(0, len(at), 4096):
                q = at[i : i + 4096]
                near = np.bitwise_count(every[q][:, None] ^ homes[own][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b, at_home = q[a], own[b], home[i : i + 4096][a]
                keep = ~at_home | (a > b)
                if keep.any():
                    yield a[keep], b[keep]
            return
        d = np.bitwise_count(every[at] ^ node.point).astype(int)
        inner = d <= node.mu
        go_in = np.where(home, inner, d <= node.mu + radius)
        go_out = np.where(home, ~inner | (d > node.mu - radius), d > node.mu - radius)
        yield from down(node.inside, at[go_in], home[go_in])
        yield from down(node.outside, at[go_out], home[go_out] & ~inner[go_out])

    yield from down(tree, np.arange(len(every)), np.arange(len(every)) < n)


class Forest:
    """Union-find over places; keeps the smallest place of each tree as its root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while (p[p] != p).any():
                p = p[p]
            self.parent = p

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (``src``, ``dst``) that join all fingerprints of column ``fp`` (distinct) within ``radius`` bits.

    A vantage-point tree over a bounded sample (PER_SHARD for each shard) cuts the fingerprints into shards;
    each goes to its home and to the shards that :func:`route` says it must visit. A task takes one
    shard, builds the tree of its homes and gives back, instead of all pairs, the edges of a spanning
    forest of its links. Links are exact: no pair within the radius is missed."""
    rows = distinct.count()
    shards = 1 << max(0, min(int(math.log2(MOST_SHARDS)), math.ceil(math.log2(max(1, rows / shard)))))
    drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, PER_SHARD * shards / max(1, rows))))
    sample = distinct.where(drawn).orderBy("fp").toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    tree = build(sample, max(1, len(sample) // shards), depth=max(0, int(math.log2(shards))))
    leaves = []

    def number(node):
        if node.inside is None:
            node.shard, node.members = len(leaves), None
            leaves.append(node)
        else:
            number(node.inside)
            number(node.outside)

    number(tree)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(dtype=np.int64)
            at, to, home = route(tree, fps.view(np.uint64), radius)
            yield pd.DataFrame({"fp": fps[at], "shard": to, "home": home})

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp")
        homes = rows.loc[rows["home"], "fp"].to_numpy(dtype=np.int64)
        visitors = rows.loc[~rows["home"], "fp"].to_numpy(dtype=np.int64)
        every, forest = np.concatenate([homes, visitors]), Forest(len(rows))
        if len(homes):
            for a, b in near_pairs(homes.view(np.uint64), visitors.view(np.uint64), radius):
                forest.add(a, b)
        child, parent = forest.edges()
        return pd.DataFrame({"src": every[child], "dst": every[parent]})

    sent = distinct.select("fp").mapInPandas(send, "fp long, shard int, home boolean")
    return sent.groupBy("shard").applyInPandas(link, "src long, dst long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(``id_col``, ``carry`` columns, ``fingerprint``, ``component_id``, ``part``) of each row; ``part`` (the
    smallest fingerprint, signed) tells components apart even where they have no id or share one.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    id that links reach. Rows with one fingerprint are one class from the start, so copies cost nothing
    further, and only links between classes are searched (:func:`link_fingerprints`).

    Defined cases: texts without words and null texts have the fingerprint 0 and are linked like any
    other; a row with a null id takes part but names no component (a component of only such rows has a
    null id); repeated rows come back each; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words, carry), "simhash")
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    edges = link_fingerprints(classes.select("fp"), radius)
    parts = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("_part"))
    classes = classes.join(parts, "fp", "left").withColumn("_part", F.coalesce("_part", "fp"))
    least = classes.groupBy("_part").agg(F.min("_least").alias("component_id"))
    named = materialize(classes.join(least, "_part").select("fp", "component_id", F.col("_part").alias("part")), "simhash-parts")
    return rows.join(named, "fp").select(id_col, *carry, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "part")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last; one of its repeated rows).

    The columns of ``docs`` stay as they are. Rows are numbered in a written copy, and the numbers of the
    rows that go are taken out by an anti-join (broadcast up to 200,000 of them)."""
    row = fresh(docs, "_row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    rows = materialize(simhash_components(keyed, id_col, text_col, words, radius, (row,)).select(F.col(id_col).alias("i"), F.col(row).alias("r"), "part"), "simhash-rows")
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "r")).alias("f"))
    stays = first.select(F.col("f.r").alias("r"))
    goes = materialize(rows.select("r").join(stays, "r", "left_anti").select(F.col("r").alias(row)), "simhash-goes")
    if goes.count() <= 200_000:
        goes = F.broadcast(goes)
    return keyed.join(goes, row, "left_anti").drop(row)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("part")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
