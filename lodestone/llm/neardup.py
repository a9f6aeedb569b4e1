"""One of each group of near-duplicates: SimHash links, made whole by a search on prefixes of the shingle sets, all
verified by the exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import simhash
from lodestone.llm.joins import HEAVY, fresh, lookup
from lodestone.llm.pst import mix, symbols
from lodestone.operators.components import connected_components
from lodestone.shared import forget, materialize

#: Words of a shingle; buckets (power of 2) whose counts order shingles, which only saves work; rounds in which
#: each shingle's documents meet one of them before all that are left meet each other.
WORDS, BUCKETS, ROUNDS = 5, 17, 2
#: Rows up to which a list of row numbers is broadcast; texts that one task holds against one other.
BROADCAST_ROWS, MEET = 1_000_000, 200
#: Bits of the widest map of a set. Rows of a shingle that meet as pairs of rows; those of more meet by their maps, so many at most in
#: a task. Ranges of shingles whose prefixes are sent one after the other.
WIDEST, FEW, BLOCK, TURNS = 1 << 13, 8, 8192, 4


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different 64-bit hashes of the word shingles, in order; words as in simhash. Fewer words than a shingle has: the whole
    sequence is the one shingle. No words or null: none."""
    s = symbols(text)[:-1]
    if not len(s):
        return s
    size = min(words, len(s))
    last = len(s) - size + 1
    return np.unique(reduce(mix, [s[i : i + last] for i in range(1, size)], s[:last]))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets without repeats have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parity(own: np.ndarray) -> bytes:
    """A map of the set: bit i tells whether an odd number of its hashes end in i. The width is a power of 2 from four times the
    set's size on, 64 to WIDEST. Two maps of one width differ in no more bits than there are hashes in only one of the sets."""
    width = min(WIDEST, max(64, 1 << (4 * len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Maps (a row of 64-bit words each) at the smaller width of ``size`` words."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_be_alike(a: tuple[int, bytes], b: tuple[int, bytes]) -> bool:
    """False only for sets (size and map) that aren't alike: n + m - 2 * both is the number of hashes in only one of them, at most
    (n + m) / 9 where both are alike."""
    x, y = (np.frombuffer(bits, np.uint64)[None, :] for _, bits in (a, b))
    size = min(x.shape[1], y.shape[1])
    return 9 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)) <= a[0] + b[0]


def met(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``row`` of one shingle that may be alike: not of one ``part``, where ``cross`` not of one ``side``, not told apart by
    sizes, places or maps (``n``, ``place``, ``bits``)."""
    rows = rows.sort_values("n", kind="stable")
    n, place, part, row, side = (rows[x].to_numpy(dtype=np.int64) for x in ("n", "place", "part", "row", "side"))
    words, cross = np.array([len(x) // 8 for x in rows["bits"]]), bool(rows["cross"].iloc[0])
    for size in np.unique(words):  # of sizes that may be alike, one is at most twice as wide as the other
        near = np.flatnonzero((words == size) | (words == 2 * size))
        own = int((words[near] == size).sum())  # wider maps are of larger sets
        flat = [np.frombuffer(b"".join(rows["bits"].iloc[near[words[near] == w]]), np.uint64).reshape(-1, w) for w in (size, 2 * size)]
        bits = np.concatenate([flat[0], folded(flat[1], size)])
        last = np.searchsorted(4 * n[near], 5 * n[near[:own]], side="right")
        for i in range(own):
            to = near[i + 1 : last[i]]
            both, a = 4 * (n[near[i]] + n[to]), near[i]
            keep = (part[to] != part[a]) & (9 * (n[a] - place[a]) >= both) & (9 * (n[to] - place[to]) >= both)
            if cross:
                keep &= side[to] != side[a]
            at = np.flatnonzero(keep)
            if len(at):
                apart = np.bitwise_count(bits[i + 1 + at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                to = to[at[9 * apart <= n[a] + n[to[at]]]]
                if len(to):
                    yield np.minimum(row[a], row[to]), np.maximum(row[a], row[to])


def sketches(docs: DataFrame, row: str, text_col: str) -> DataFrame:
    """(``row``, ``digest`` of the shingles, ``n`` of them, ``prefix``, ``bits``) of each row: the first n - ceil(0.8 n) + 1
    shingles, those of rare buckets first, and the map of all (:func:`parity`)."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found += np.bincount((shingles(text) >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=1 << BUCKETS)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"b": at, "c": found[at]})

    texts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    counted = texts.select("text").mapInPandas(tally, "b long, c long").groupBy("b").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(1 << BUCKETS, np.int64)
    counts[counted["b"].to_numpy(dtype=np.int64)] = counted["c"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                own = shingles(text)
                order = np.lexsort((own, shared.value[(own >> np.uint64(64 - BUCKETS)).astype(np.int64)]))
                first = own[order[: len(own) - (4 * len(own) + 4) // 5 + 1]].view(np.int64)
                out.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), first, parity(own)))
            yield pd.DataFrame({"row": batch["row"]} | {k: [x[i] for x in out] for i, k in enumerate(("digest", "n", "prefix", "bits"))})

    return texts.mapInPandas(sketch, "row long, digest binary, n long, prefix array<long>, bits binary")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of rows of ``texts`` (``row``, ``text``) that are alike.

    First their maps meet (``classes``: ``row``, ``n``, ``bits``); shingle sets are made and sent only for the pairs that these don't tell apart."""
    pairs = materialize(pairs, "near-pairs")
    maps = classes.select("row", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "bits").alias("own"))
    near = held_together(pairs, maps, lambda x: (int.from_bytes(x[:8], "big"), x[8:]), may_be_alike)
    forget(pairs)
    rows = near.select(F.col("a").alias("row")).union(near.select("b")).distinct()
    asked = materialize(rows, "near-asked")
    rows = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "own": [shingles(t).tobytes() for t in batch["text"]]})

    sets = materialize(texts.join(rows, "row", "left_semi").mapInPandas(read, "row long, own binary"), "near-sets")
    out = held_together(near, sets, lambda x: np.frombuffer(x, np.uint64), alike)
    forget(near, asked, sets)
    return out


def held_together(pairs: DataFrame, table: DataFrame, read: Callable, test: Callable) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose ``own`` of ``table`` (``row``, ``own``) pass the ``test``. Up to MEET rows meet one ``b`` in a
    task; a ``b`` with more goes to more tasks."""
    degree = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("many")), "near-degree")
    total = degree.agg(F.sum("many")).head()[0] or 0
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("many") / MEET)).alias("salt")
    bucket = F.pmod(F.xxhash64("b", "salt"), F.lit(max(1, total // (2 * MEET)))).alias("bucket")
    dealt = lookup(pairs, degree, "b", F.col("many") >= total / HEAVY).select("a", "b", salt)
    dealt = materialize(dealt.select("a", "b", "salt", bucket), "near-dealt")
    left = dealt.select("a", "b", "bucket").join(table.toDF("a", "own_a"), "a").groupBy("bucket")
    once = dealt.select(F.col("b").alias("to"), F.col("bucket").alias("share")).distinct()
    right = once.join(table.toDF("to", "own_b"), "to").groupBy("share")

    def meet(many: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        own = {b: read(x) for b, x in zip(one["to"], one["own_b"])}
        near = [test(own[b], read(x)) for b, x in zip(many["b"], many["own_a"])]
        return many.loc[near, ["a", "b"]]

    out = materialize(left.cogroup(right).applyInPandas(meet, "a long, b long"), "near-links")
    forget(degree, dealt)
    return out


def crowds(now: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of rows of ``now`` (``shingle``, ``row``, ``n``, ``place``, ``part``) that share a shingle of over FEW rows (``sizes``:
    ``shingle``, ``many``) and may be alike, by :func:`met`. Over BLOCK rows are cut in blocks, any two of which meet in a task."""
    sizes = sizes.where(F.col("many") > FEW)
    total = sizes.agg(F.sum("many")).head()[0] or 0
    rows = lookup(now, sizes, "shingle", F.col("many") >= total / HEAVY).join(classes.select("row", "bits"), "row")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = F.xxhash64("shingle", F.least("side", "other"), F.greatest("side", "other"))
    rows = rows.select(
        F.pmod(meeting, F.lit(max(16, total // BLOCK))).alias("task"), meeting.alias("meeting"), "row", "n", "place", "part", "bits", "side", "other"
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 2]
        for _, own in rows.groupby("meeting"):
            out += met(own.assign(cross=bool((own["side"] != own["other"]).any())))
        return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate("ab")}).drop_duplicates()

    return rows.groupBy("task").applyInPandas(meet, "a long, b long")


def links(texts: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """(``a``, ``b``): links enough to join all ``classes`` (``row``, ``n``, ``prefix``, ``bits``) whose similarity is 0.8 or more, and no others.

    First, rows whose SimHash ``prints`` (``row``, ``fp``) are within 3 bits. Then the search that makes it whole: a pair has ceil(0.8 n)
    of the n shingles of either in common, so it shares one among the first n - ceil(0.8 n) + 1 of both, in any order that all
    sets share. Twice, all rows of a prefix shingle that aren't joined yet meet a drawn one of them, so that a group of m copies
    costs about m meetings; then all that share a prefix shingle and are still not joined meet, but for those that can't be alike: the
    first shingle in common is at a place with enough shingles after it in both, and maps tell how far sets differ at least. Where a shingle has over
    FEW rows, they meet inside a task (:func:`crowds`), which gives back only pairs that may be alike. None is missed, none is wrong."""
    first = materialize(prints.groupBy("fp").agg(F.min("row").alias("least")), "near-prints")
    near = simhash.link_fingerprints(first.select("fp"))
    near = near.join(first.toDF("src", "a"), "src").join(first.toDF("dst", "b"), "dst").select("a", "b")
    same = prints.join(first, "fp").where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    found = [verified(near.union(same), texts, classes)]
    total = classes.agg(F.sum(F.size("prefix"))).head()[0] or 0
    often, kept = [], []
    for turn in range(TURNS):  # a range of the shingles at a time, so that less is in the shuffle at once
        posted = classes.select(F.posexplode("prefix").alias("place", "shingle"), "row", "n").where(F.pmod("shingle", F.lit(TURNS)) == turn)
        often.append(materialize(posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "near-often"))
        kept.append(materialize(lookup(posted, often[-1], "shingle", F.col("many") >= total / HEAVY), "near-shared"))
    forget(first)
    spent_last = [*often, *kept]
    often, kept = reduce(DataFrame.union, often), reduce(DataFrame.union, kept)
    sizes = (5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n"))
    for turn in range(ROUNDS + 1):
        parts = connected_components(reduce(DataFrame.union, found).toDF("src", "dst"))
        now = kept.join(parts.toDF("row", "part"), "row", "left").withColumn("part", F.coalesce("part", "row"))
        drawn = F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("h"), F.col("row").alias("b"), F.col("n").alias("m"), F.col("part").alias("other")))
        mixed = now.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y"), drawn.alias("d")).where("x < y")
        mixed = materialize(mixed.select("shingle", "d.b", "d.m", "d.other"), "near-mixed")
        spent = [mixed]
        if turn < ROUNDS:
            heavy = materialize(mixed.join(often, "shingle"), "near-mixed")
            spent.append(heavy)
            pairs = lookup(now.drop("many"), heavy, "shingle", F.col("many") >= total / HEAVY).where((F.col("part") != F.col("other")) & sizes)
            pairs = pairs.select(F.col("row").alias("a"), "b").distinct()
        else:
            now = materialize(now.join(mixed.select("shingle"), "shingle", "left_semi").select("shingle", "row", "n", "place", "part"), "near-open")
            many = materialize(now.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")), "near-many")
            spent += [now, many]
            few = now.join(many.where(F.col("many") <= FEW).select("shingle"), "shingle", "left_semi")
            pairs = few.withColumnsRenamed({"row": "a", "place": "i"}).join(few.toDF("shingle", "b", "m", "j", "other"), "shingle")
            both = 4 * (F.col("n") + F.col("m"))
            ahead = (9 * (F.col("n") - F.col("i")) >= both) & (9 * (F.col("m") - F.col("j")) >= both)
            pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("part") != F.col("other")) & sizes & ahead).select("a", "b")
            pairs = pairs.union(crowds(now, many, classes)).distinct()
        found.append(verified(pairs, texts, classes))
        forget(*spent)  # the links are written
    forget(*spent_last)
    return reduce(DataFrame.union, found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of linked rows: that of the smallest id (nulls last; one of its
    repeated rows). Rows with the same shingles, or none, are one class from the start.

    Defined cases: null texts and those without words are alike; texts of fewer than five words are alike if their words are the
    same; repeated rows leave one; very long texts count with all their shingles; an empty table stays empty; the columns
    stay as they are, whatever their names."""
    row = fresh(docs, "_row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    texts = keyed.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    sketched = materialize(sketches(keyed, row, text_col), "near-rows")
    named = materialize(sketched.groupBy("digest").agg(F.min("row").alias("row")), "near-classes")
    own = named.select("row")
    own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    classes = materialize(sketched.where("n > 0").join(own, "row", "left_semi").select("row", "n", "prefix", "bits"), "near-classes")
    slim = materialize(sketched.select("row", "digest"), "near-digests")
    forget(sketched)
    sketched = slim
    prints = materialize(simhash.fingerprints(texts, "row", "text", WORDS).join(classes.select("row"), "row", "left_semi"), "near-fingerprints")
    parts = connected_components(links(texts, classes, prints).toDF("src", "dst"))
    forget(classes)
    parts = named.join(parts.toDF("row", "part"), "row", "left").select("digest", F.coalesce("part", "row").alias("part"))
    ids = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    rows = materialize(lookup_digest(sketched.select("row", "digest"), parts).join(ids, "row"), "near-parts")
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"))).alias("f"))
    goes = materialize(rows.select("row").join(first.select(F.col("f.r").alias("row")), "row", "left_anti").select(F.col("row").alias(row)), "near-goes")
    forget(sketched, named, prints, rows)
    return keyed.join(F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes, row, "left_anti").drop(row)


def lookup_digest(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(``row``, ``part``) of all ``rows``; a digest that many rows have is no hot key."""
    many = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("many"))
    known = materialize(parts.join(many, "digest"), "near-known")
    total = known.agg(F.sum("many")).head()[0] or 0
    return lookup(rows, known, "digest", F.col("many") >= total / HEAVY).select("row", "part")
