"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.joins import HEAVY, lookup
from lodestone.shared import forget, materialize

#: Longest context in words; least count, at every size, of a context and of an entry (a context and a word after it).
DEPTH, LEAST = 3, 2
#: A context stays if its divergence from the next shorter one is at least so many nats a token, and above chance
#: by so many standard deviations of the likelihood-ratio statistic. Weight of the shorter context in smoothing.
DIVERGENCE, DEVIATIONS, PRIOR = 0.005, 4.0, 2.0
#: Tokens of a bundle of texts, tokens for each part of a table, bytes of a text that are parted at once, rounds in which
#: bundles ask the tree.
BUNDLE, PART, SLICE, ROUNDS = 1 << 19, 1 << 21, 1 << 24, 4
#: Bits (power of 2) of the maps that tell most keys that are not in a table. They only save work: what they let
#: through is counted or looked up exactly.
MAP = 27
END = b" "  # no word has a space
#: Tells the key of a context's weight from that of the same words as an entry.
CONTEXT = 0x3C6EF372FE94F82B


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased, parted by U+0020 and U+0009 to U+000D, then the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def symbols(text: str | None) -> np.ndarray:
    """Symbols of the tokens of a text: the 64-bit SipHash of each (never 0). The text is parted a slice at a time."""
    data, out, at = (text or "").encode("utf-8", "replace").lower(), [], 0
    while at < len(data):
        stop = re.compile(rb"[\x20\x09-\x0d]").search(data, at + SLICE) if at + SLICE < len(data) else None
        part = data[at : stop.start()] if stop else data[at:]
        at = stop.end() if stop else len(data)
        out.append(pd.util.hash_array(np.array([*part.split(), b""], dtype=object)[:-1], categorize=False))
    out = np.concatenate([*out, pd.util.hash_array(np.array([END], dtype=object), categorize=False)])
    out[out == 0] = 1
    return out


def mix(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """64-bit key of a sequence of words from those of the sequence without its last and without its first word."""
    x = (context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)) ^ suffix
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def grams(s: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For 1 to ``order`` words: the key of the words that end at each place of ``s`` (a zero stands before each
    text), and whether all are of one text."""
    keys, whole = [s], [s != 0]
    for _ in range(order - 1):
        before, there = np.roll(keys[-1], 1), np.roll(whole[-1], 1)
        there[:1] = False
        keys.append(mix(before, keys[-1]))
        whole.append(whole[-1] & there)
    return keys, whole


def _planes(x: np.ndarray) -> bytes:
    """Integers (or floats) with their first, second and so on bytes together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unplane(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order, as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unplane(data, np.uint64), dtype=np.uint64)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@dataclass
class Bits:
    """A map with a bit for each key of some table by the key's leading ``log`` bits."""

    log: int
    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.log)
        return (self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    @staticmethod
    def run(keys: np.ndarray, log: int, part: int, parts: int) -> bytes:
        """The bytes of the map for one of ``parts`` equal ranges of keys."""
        size = 1 << (log - parts)
        found = np.zeros(size, bool)
        found[(keys >> np.uint64(64 - log)).astype(np.int64) - part * size] = True
        return zstandard.ZstdCompressor(level=1).compress(np.packbits(found, bitorder="little").tobytes())

    @staticmethod
    def of(rows: DataFrame, log: int, parts: int) -> Bits:
        """The map of the only column of ``rows``, keys as longs."""
        rows = rows.toDF("key").withColumn("part", F.shiftrightunsigned("key", 64 - parts).cast("int"))

        def run(own: pd.DataFrame) -> pd.DataFrame:
            part = int(own["part"].iloc[0])
            return pd.DataFrame([{"part": part, "bits": Bits.run(own["key"].to_numpy(dtype=np.int64).view(np.uint64), log, part, parts)}])

        return Bits.gather(rows.repartition(2 << parts, "part").groupBy("part").applyInPandas(run, "part int, bits binary"), log, parts)

    @staticmethod
    def gather(rows: DataFrame, log: int, parts: int) -> Bits:
        """The map from rows of (``part``, ``bits``); 2^MAP bits at most."""
        out = np.zeros(1 << (log - 3), np.uint8)
        size = 1 << (log - parts - 3)
        for r in rows.where("bits is not null").select("part", "bits").collect():
            out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8)
        return Bits(log, out)


BUNDLES = "bundle long, tokens long, trained long, id binary, missing binary, train binary, length binary, words binary, codes binary"


def encode(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in bundles of about BUNDLE tokens (or one text): ids, which rows are learned from (``train``; default all), lengths, the
    different words as 64-bit hashes and each token's place among them. Two words of one hash would be taken
    for one: among 10^9 different words that is to be expected for 0.03 pairs."""
    key = F.col(id_col).cast("long")
    source = docs.select(F.col(text_col).alias("text"), F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("missing"), (F.lit(True) if train is None else train).alias("train"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, held, rows, size = TaskContext.get().partitionId() << 33, [], [], 0

        def pack():
            codes, words = pd.factorize(np.concatenate(held))
            order = np.argsort(-np.bincount(codes), kind="stable")  # low places for frequent words
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            length = np.array([len(x) for x in held])
            own = np.array([r[2] for r in rows], bool)
            return pd.DataFrame([{
                "bundle": bundle, "tokens": size, "trained": int(length[own].sum()), "id": np.array([r[0] for r in rows], np.int64).tobytes(),
                "missing": np.array([r[1] for r in rows], bool).tobytes(), "train": own.tobytes(), "length": length.tobytes(),
                "words": words[order].tobytes(), "codes": _planes(place[codes]),
            }])

        for batch in batches:
            for text, *row in zip(batch["text"], batch["id"], batch["missing"], batch["train"]):
                held.append(symbols(text))
                rows.append(row)
                size += len(held[-1])
                if size >= BUNDLE:
                    yield pack()
                    bundle, held, rows, size = bundle + 1, [], [], 0
        if rows:
            yield pack()

    return source.mapInPandas(read, BUNDLES)


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, each token's place among them, lengths of the texts, symbols with a zero before each text, whether
    each of those is learned from)."""
    words, codes = np.frombuffer(row["words"], np.uint64), _unplane(row["codes"], np.uint32)
    length, train = np.frombuffer(row["length"], np.int64), np.frombuffer(row["train"], bool)
    s = np.zeros(len(codes) + len(length), np.uint64)
    s[np.arange(len(codes)) + np.repeat(np.arange(1, len(length) + 1), length)] = words[codes]
    return words, codes, length, s, np.repeat(train, length + 1)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_dict("records")


def count_grams(bundles: DataFrame, order: int, parts: int, log: int, shorter: Bits | None, open_: Bits | None) -> DataFrame:
    """Sequences of ``order`` words: ``key``, ``context`` and ``suffix`` (their keys without the last and the first
    word) and ``c`` over all rows learned from, and for each part of the keys a row with its ``bits``.

    Those of one word are all kept; of longer ones those of LEAST, and only sequences whose context and suffix have
    the bit in ``shorter``, and a context whose own suffix has the bit in ``open_``, are counted at all. A bundle sends each sequence once with its count, packed by
    ranges of the key, so no sequence is frequent in the shuffle."""
    shared, shift = bundles.sparkSession.sparkContext.broadcast((shorter, open_)), np.uint64(64 - parts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            words, codes, length, s, train = _opened(row)
            if order == 1:
                c = np.bincount(codes[np.repeat(np.frombuffer(row["train"], bool), length)], minlength=len(words))
                key, c = words[c > 0], c[c > 0]
                by = np.argsort(key)
                key, c = key[by], c[by]
                context = suffix = key[:0]
            else:
                (known, more), (keys, whole) = shared.value, grams(s, order)
                at = np.flatnonzero(whole[-1] & train)
                at = at[more.has(keys[-3][at - 1])] if more else at
                at = at[known.has(keys[-2][at - 1])]
                at = at[known.has(keys[-2][at])]
                key = keys[-1][at]
                by = np.argsort(key)
                key, at = key[by], at[by]
                first = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
                c, key, at = np.diff(np.append(first, len(key))), key[first], at[first]
                context, suffix = keys[-2][at - 1], keys[-2][at]
            found, cuts = np.unique(key >> shift, return_index=True)
            out = []
            for part, a, b in zip(found.astype(np.int64), cuts, [*cuts[1:], len(key)]):
                by = a + np.argsort(context[a:b]) if order > 1 else slice(a, b)  # equal contexts together compress well
                data = (key[by] if order == 1 else np.concatenate([context[by], suffix[by]])).tobytes()
                out.append((part, zstandard.ZstdCompressor(level=1).compress(data), _planes(c[by].astype(np.uint32))))
            yield pd.DataFrame(out, columns=["part", "keys", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part, flat = int(rows["part"].iloc[0]), [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint64) for x in rows["keys"]]
        c = np.concatenate([_unplane(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
        rows = None
        if order == 1:
            key = np.concatenate(flat)
            context = suffix = key[:0]
        else:
            context = np.concatenate([x[: len(x) // 2] for x in flat])
            suffix = np.concatenate([x[len(x) // 2 :] for x in flat])
            key = mix(context, suffix)
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        c, key, at = np.add.reduceat(c[by], first), key[first], by[first]
        frequent = c >= LEAST
        bits = Bits.run(key[frequent], log, part, parts)
        if order > 1:
            c, key, at = c[frequent], key[frequent], at[frequent]
        near = [_long(x[at]) if order > 1 else 0 for x in (context, suffix)]
        out = {"key": _long(key), "context": near[0], "suffix": near[1], "c": c, "part": -1, "bits": None}
        return pd.concat([pd.DataFrame(out), pd.DataFrame([{"key": 0, "context": 0, "suffix": 0, "c": 0, "part": part, "bits": bits}])])

    sent = bundles.mapInPandas(count, "part int, keys binary, counts binary").repartition(2 << parts, "part")
    return sent.groupBy("part").applyInPandas(merge, "key long, context long, suffix long, c long, part int, bits binary")


PACKED = "part int, words binary, words_value binary, grams binary, grams_value binary, bits binary"


@dataclass
class Tree:
    """``n`` tokens, ``v`` different ones. ``packed``: for each of 2^``parts`` ranges of keys the keys in order and
    their values: of ``words`` the count, of ``grams`` in single precision log10 of an entry's probability or, for a
    context (key ^ CONTEXT), of the weight of the shorter one. ``bits``: keys of entries and contexts."""

    n: int
    v: int
    packed: DataFrame
    parts: int
    bits: Bits


def retained(level: DataFrame, shorter: DataFrame, counts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Entries of one length (``key``, ``c``, ``total`` of the context, ``p``) and their contexts (``context``, ``total``,
    ``s``, ``open``) that stay, from what :func:`count_grams` found of one length (``level``) and of a context's length (``counts``), and
    the entries that are a word shorter.

    After a context, entries are the words seen LEAST times; ``s`` occurrences with other words together are one more outcome. A
    context stays if the one a word shorter does and its distribution over these diverges from that one's: the
    likelihood-ratio statistic 2 * total * KL is above its mean by chance (the number of entries) by
    DEVIATIONS of its standard deviations, and KL is at least DIVERGENCE. There p is
    (c + (s + PRIOR) * p in the shorter) / (total + PRIOR), and a word that is no entry has (s + PRIOR) /
    (total + PRIOR) of its share in the shorter. ``open``: longer ones may diverge from it."""
    heavy = F.col("of") >= n / HEAVY  # counts of one length sum to n at most
    below = shorter.select(F.col("key").alias("suffix"), F.col("c").alias("of"), (F.col("c") / F.col("total")).alias("q"), F.col("p").alias("base"))
    own = lookup(level.where("bits is null").select("key", "context", "suffix", "c"), below, "suffix", heavy)
    own = materialize(own.select("key", "context", "c", "q", "base"), "lm-own")
    found = own.groupBy("context").agg(F.sum("c").alias("d"), F.sum(F.col("c") * F.log(F.col("c") / F.col("q"))).alias("g"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("k"))
    found = found.join(counts.select(F.col("key").alias("context"), F.col("c").alias("total")), "context").withColumn("s", F.col("total") - F.col("d"))
    others = F.when(F.col("s") > 0, F.col("s") * F.log(F.col("s") / F.greatest(1 - F.col("q"), F.lit(1e-9)))).otherwise(0.0)
    gain = F.col("g") + others - F.col("total") * F.log("total")
    found = found.where((gain >= DIVERGENCE * F.col("total")) & (2 * gain > F.col("k") + DEVIATIONS * F.sqrt(2.0 * F.col("k"))))
    found = materialize(found.select("context", "total", "s", ((F.col("k") > 1) | (F.col("s") > 0)).alias("open")), "lm-contexts")
    out = lookup(own, found.drop("open"), "context", F.col("total") >= n / HEAVY)
    p = (F.col("c") + (F.col("s") + PRIOR) * F.col("base")) / (F.col("total") + PRIOR)
    out = materialize(out.select("key", "c", "total", p.alias("p")), "lm-level")
    forget(own)
    return out, found


def fit(bundles: DataFrame) -> Tree:
    """The tree learned from the rows of ``bundles`` (see :func:`encode`) that are to be learned from.

    All words are symbols. Contexts of up to DEPTH words and entries after them count from LEAST occurrences on, at every
    size, and stay if they pass :func:`retained`: the tree grows with the text, from short contexts to longer ones. Where the same word
    always follows a context, it follows all longer ones too: they can't diverge, and entries of the longest aren't counted there. The shortest state, without a context, gives a word
    (c + 1) / (n + v + 1). No rows: a tree that knows no word."""
    n = bundles.agg(F.sum("trained")).head()[0] or 0
    parts = max(3, math.ceil(math.log2(max(1, n / PART))))
    log = max(parts + 3, 16, min(MAP, math.ceil(math.log2(max(1, n))) + 1))
    words = materialize(count_grams(bundles, 1, parts, log, None, None), "lm-words")
    plain = words.where("bits is null")
    v = plain.count()
    shorter = plain.select("key", "c", F.lit(n).cast("long").alias("total"), ((F.col("c") + 1.0) / (n + v + 1.0)).alias("p"))
    open_, bits, rows, spent = None, Bits.gather(words, log, parts), plain.select("key", F.col("c").cast("double").alias("value"), F.lit(False).alias("gram")), [words]
    counts = words
    for order in range(2, DEPTH + 2):
        level = materialize(count_grams(bundles, order, parts, log, bits, open_), "lm-grams")
        bits = Bits.gather(level, log, parts)
        shorter, contexts = retained(level, shorter, counts.where("bits is null"), n)
        if order > 2:
            forget(counts)
        counts = level
        if order == DEPTH:
            open_ = Bits.of(contexts.where("open").select("context"), log, parts)
        weight = F.log10((F.col("s") + PRIOR) / (F.col("total") + PRIOR))
        context = contexts.select(F.col("context").bitwiseXOR(F.lit(CONTEXT)).alias("key"), weight.alias("value"), F.lit(True).alias("gram"))
        rows = rows.union(shorter.select("key", F.log10("p").alias("value"), F.lit(True).alias("gram"))).union(context)
        spent += [shorter, contexts]
    forget(counts)

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        part, gram = int(own["part"].iloc[0]), own["gram"].to_numpy(dtype=bool)
        key, value = own["key"].to_numpy(dtype=np.int64).view(np.uint64), own["value"].to_numpy(dtype=float)
        out = {"part": part, "bits": Bits.run(key[gram], log, part, parts)}
        for kind, which, dtype in (("words", ~gram, np.uint64), ("grams", gram, np.float32)):
            order = np.argsort(key[which])
            out[kind] = _packed(key[which][order])
            out[f"{kind}_value"] = _planes(value[which][order].astype(dtype))
        return pd.DataFrame([out])

    rows = rows.withColumn("part", F.shiftrightunsigned("key", 64 - parts).cast("int"))
    packed = rows.repartition(2 << parts, "part").groupBy("part").applyInPandas(pack, PACKED)
    packed = materialize(packed, "lm-packed")
    forget(*spent)
    return Tree(n, v, packed, parts, Bits.gather(packed, log, parts))


def _asked(words: np.ndarray, s: np.ndarray, bits: Bits) -> tuple[np.ndarray, np.ndarray, list]:
    """The order of the words by key; the keys of contexts and entries that a bundle must look up, in order; for each length from DEPTH down (places with a context that may be known, their places among the keys, the
    same for entries)."""
    keys, whole = grams(s, DEPTH + 1)
    wanted, at = [], np.flatnonzero(whole[1])
    for d in range(1, DEPTH + 1):  # a context is in the tree only if all shorter ones are, and an entry only if its context is
        at = at[whole[d][at]]
        k = keys[d - 1][at - 1] ^ np.uint64(CONTEXT)
        may = bits.has(k)
        at, k = at[may], k[may]
        entry = at[bits.has(keys[d][at])]
        wanted = [(at, k), (entry, keys[d][entry]), *wanted]
    places, unique = pd.factorize(np.concatenate([k for _, k in wanted]))
    order = np.argsort(unique)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    unique, places = unique[order], rank[places]
    cuts = np.cumsum([0, *[len(k) for _, k in wanted]])
    return np.argsort(words), unique, [(at, places[a:b]) for (at, _), a, b in zip(wanted, cuts[:-1], cuts[1:])]


def score(bundles: DataFrame, tree: Tree, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, ``n_tokens``, ``n_known``, ``base_score``, ``score``) of each row of ``bundles``.

    A bundle's words, and its contexts and entries that may be in the tree, go once each to the ranges of the
    tree that hold their keys; the values come back to the bundle, which scores its places: the longest
    context that has an entry for the word gives its probability, times the weights of the longer ones kept.
    A part of the tree meets what bundles ask of it, packed; parts grow in number with the tree.

    Defined cases: a null or empty text is the end alone; a null id comes back null; repeated rows are scored each; a text beyond
    BUNDLE tokens is a bundle of its own, in one task; an empty table gives no rows, an empty tree knows no
    word; other columns are never read."""
    parts, shift, per_token = tree.parts, np.uint64(64 - tree.parts), math.log10(tree.n + tree.v + 1)
    shared = bundles.sparkSession.sparkContext.broadcast(tree.bits)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange((1 << parts) + 1)
        for row in _rows(batches):
            words, _, _, s, _ = _opened(row)
            order, unique, *_ = _asked(words, s, shared.value)
            words = words[order]
            w, g = np.searchsorted(words >> shift, edges), np.searchsorted(unique >> shift, edges)
            own = [_packed(words[a:b]) for a, b in zip(w[:-1], w[1:])]
            yield pd.DataFrame({"bundle": row["bundle"], "part": edges[:-1], "words": own, "grams": [_packed(unique[a:b]) for a, b in zip(g[:-1], g[1:])]})

    def answer(asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {"bundle": asks["bundle"], "part": asks["part"]}
        for kind, dtype, none in (("words", np.uint64, 0), ("grams", np.float32, np.nan)):
            keys = _unpacked(own[kind].iloc[0]) if len(own) else np.zeros(0, np.uint64)
            values = np.append(_unplane(own[f"{kind}_value"].iloc[0], dtype) if len(own) else np.zeros(0, dtype), dtype(none))
            out[kind] = []
            for data in asks[kind]:
                k = _unpacked(data)
                at = np.searchsorted(keys, k)
                at[np.append(keys, np.uint64(0))[at] != k] = len(keys)
                out[kind].append(_planes(values[at]))
        return pd.DataFrame(out)

    def judge(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row, answers = rows.to_dict("records")[0], answers.sort_values("part")
        words, codes, length, s, _ = _opened(row)
        order, _, wanted = _asked(words, s, shared.value)
        c = np.empty(len(words))
        c[order] = np.concatenate([_unplane(x, np.uint64) for x in answers["words"]])
        values = np.concatenate([_unplane(x, np.float32) for x in answers["grams"]]).astype(float)
        base, starts = np.log10(c + 1)[codes], np.cumsum(length) - length
        out, open_ = np.zeros(len(s)), s != 0
        floor = np.zeros(len(s))
        floor[open_] = base - per_token
        for (at, context), (to, entry) in zip(wanted[::2], wanted[1::2]):
            found = to[open_[to] & ~np.isnan(values[entry])]
            out[found] += values[entry][open_[to] & ~np.isnan(values[entry])]
            open_[found] = False
            passed = open_[at] & ~np.isnan(values[context])
            out[at[passed]] += values[context][passed]
        out[open_] += floor[open_]
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "id": np.frombuffer(row["id"], np.int64), "missing": np.frombuffer(row["missing"], bool), "n_tokens": length,
            "n_known": add((c > 0)[codes].astype(np.int64)), "base_score": add(base) - length * per_token, "score": add(out[s != 0]),
        })

    packed, out = tree.packed.drop("bits").repartition(2 << parts, "part").groupBy("part"), []
    tasks = max(16, min(20_000, bundles.count()))
    kind = "id long, missing boolean, n_tokens long, n_known long, base_score double, score double"
    for turn in range(ROUNDS):  # a share of the bundles at a time, so that less is in the shuffle and in answers at once
        own = bundles.drop("tokens", "trained").where(F.pmod(F.xxhash64("bundle"), F.lit(ROUNDS)) == turn)
        asks = own.select("bundle", "train", "length", "words", "codes").mapInPandas(ask, "bundle long, part int, words binary, grams binary")
        found = asks.repartition(2 << parts, "part").groupBy("part").cogroup(packed).applyInPandas(answer, "bundle long, part int, words binary, grams binary")
        found = materialize(found, "lm-answers")
        judged = own.repartition(tasks, "bundle").groupBy("bundle").cogroup(found.repartition(tasks, "bundle").groupBy("bundle")).applyInPandas(judge, kind)
        out.append(materialize(judged, "lm-scores"))
        forget(found)
    out = reduce(DataFrame.union, out)
    return out.select(F.when(~F.col("missing"), F.col("id")).alias(id_col), "n_tokens", "n_known", "base_score", "score")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text has the remainder 2 by 7; a row with a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bundles = materialize(encode(docs, ~held_out()), "lm-bundles")
    tree = fit(bundles)
    scores = score(bundles, tree)
    forget(tree.packed)  # the answers are written
    return scores.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
