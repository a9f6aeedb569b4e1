"""Benchmark decontamination: BM25 over test items with block-max WAND, verified by overlap."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: BM25's constants; items in a block of postings; the least score of a hit as a share of the item's score
#: against itself; words of a shingle and the least overlap of question and answer.
K1, B, BLOCK, SHARE, SHINGLE, OVERLAP = 1.2, 0.75, 4, 0.6, 5, 0.8
#: Runs of blocks for which a passage's highest possible score is summed before its postings are walked.
GROUPS = 128
#: Bytes of item texts in one index; more items make more indexes, each run over all passages.
INDEX_BYTES = 8 << 20
#: Spellings that a worker remembers; characters of texts handled at once.
MEMORY, PIECE = 500_000, 1 << 21
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased: punctuation, case and spacing don't hide a passage."""
    return WORD.findall(text.lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence (or line) of an item is its answer, what is before it the
    question; an item of a single sentence is parted after three quarters of its words."""
    parts = [w for w in (words(x) for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip())) if w]
    if len(parts) >= 2:
        return [w for p in parts[:-1] for w in p], parts[-1]
    flat = parts[0] if parts else []
    cut = max(1, len(flat) * 3 // 4)
    return flat[:cut], flat[cut:]


def shingles(seq: list[str]) -> set[tuple[str, ...]]:
    return {tuple(seq[i : i + SHINGLE]) for i in range(max(1, len(seq) - SHINGLE + 1))} if seq else set()


@dataclass
class Index:
    """Inverted index of some items. Impacts are BM25 contributions divided by the item's score against
    itself, so SHARE is the threshold for each item. ``postings``: for each term (item places ascending,
    impacts); ``blocks``: for each term (block numbers, their highest impacts); ``bound``: highest impact; ``groups``: for each
    term the highest impact in each of at most GROUPS runs of blocks."""

    ids: list = field(default_factory=list)
    question: list[set] = field(default_factory=list)
    answer: list[set] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    blocks: list[dict[int, float]] = field(default_factory=list)
    bound: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    groups: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    longest: int = 1

    def query(self, terms: np.ndarray, share: float = SHARE) -> list[tuple[int, float]]:
        """(item place, score) of all items that score at least ``share`` for these distinct terms, by
        block-max WAND: cursors stand in the order of their items; the pivot is the first at which the
        terms' highest impacts reach the threshold; if the impacts of the pivot's blocks don't, all
        cursors up to it jump behind the shortest of those blocks, and else the item is scored."""
        lists = [(self.postings[t], self.blocks[t], float(self.bound[t])) for t in terms]
        at, out = [0] * len(lists), []
        now = [int(p[0][0]) for p, _, _ in lists]
        end = len(self.ids)
        order = sorted(range(len(lists)), key=now.__getitem__)
        while True:
            order.sort(key=now.__getitem__)
            total, pivot = 0.0, -1
            for k, i in enumerate(order):
                if now[i] >= end:
                    break
                total += lists[i][2]
                if total >= share - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
                pivot += 1
            block = item // BLOCK
            upper = sum(lists[i][1].get(block, 0.0) for i in order[: pivot + 1])
            if upper < share - 1e-6:
                target = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    target = min(target, max(item + 1, now[order[pivot + 1]]))
            else:
                score = 0.0
                target = item + 1
                for i in order[: pivot + 1]:
                    places, impacts = lists[i][0]
                    j = at[i] = int(np.searchsorted(places, item))
                    if j < len(places) and places[j] == item:
                        score += float(impacts[j])
                if score >= share - 1e-6:
                    out.append((item, score))
            for i in order[: pivot + 1]:
                places = lists[i][0][0]
                at[i] = int(np.searchsorted(places, target))
                now[i] = int(places[at[i]]) if at[i] < len(places) else end


@dataclass
class Statistics:
    """Of all items with words: how many, their mean length, and how many have each term."""

    n: int
    mean: float
    df: dict[str, int]


def statistics(texts: list[str]) -> Statistics:
    bags = [b for b in (Counter(w for part in split_item(t) for w in part) for t in texts) if b]
    return Statistics(len(bags), sum(sum(b.values()) for b in bags) / max(1, len(bags)), Counter(t for b in bags for t in b))


def all_statistics(texts: DataFrame) -> Statistics:
    """:func:`statistics` of the only column of ``texts``; the driver holds the vocabulary of the items."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = statistics([*batch["text"]])
            yield pd.DataFrame([(None, own.n, round(own.n * own.mean)), *((t, c, 0) for t, c in own.df.items())], columns=["term", "c", "length"])

    found = texts.toDF("text").mapInPandas(count, "term string, c long, length long").groupBy("term").agg(F.sum("c").alias("c"), F.sum("length").alias("length")).collect()
    n, length = next(((r["c"], r["length"]) for r in found if r["term"] is None), (0, 0))
    return Statistics(n, length / max(1, n), {r["term"]: r["c"] for r in found if r["term"] is not None})


def build_index(items: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
    """Index of (id, text), scored by the statistics of ``whole`` (of the items themselves if not given); items without words are left out. Items of like vocabulary (same commonest
    term) lie together, which keeps the blocks' highest impacts low."""
    index, bags = Index(), []
    for item, text in items:
        question, answer = split_item(text)
        if question or answer:
            bags.append((item, question, answer, Counter(question + answer)))
    if not bags:
        return index
    whole = whole or statistics([text for _, text in items])
    df, n, mean = whole.df, whole.n, whole.mean
    bags.sort(key=lambda b: (max(b[3], key=lambda t: (df[t], t)), b[0] is None, b[0] or 0))
    idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for b in bags for t in b[3]}
    lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for place, (item, question, answer, bag) in enumerate(bags):
        length = sum(bag.values())
        impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)) for t, f in bag.items()}
        own = sum(impact.values())
        for t, x in impact.items():
            lists[t].append((place, x / own))
        index.ids.append(item)
        index.question.append(shingles(question))
        index.answer.append(shingles(answer))
        index.longest = max(index.longest, length)
    index.bound = np.zeros(len(lists) + 1, np.float32)
    run = -(-len(bags) // GROUPS) if len(bags) > GROUPS * BLOCK else BLOCK
    index.groups = np.zeros((len(lists) + 1, -(-len(bags) // run)), np.float32)
    index.postings.append((np.zeros(0, int), np.zeros(0)))
    index.blocks.append({})
    for i, t in enumerate(sorted(lists), 1):
        places, impacts = np.array([p for p, _ in lists[t]]), np.array([x for _, x in lists[t]])
        index.terms[t] = i
        index.postings.append((places, impacts))
        top: dict[int, float] = {}
        for p, x in lists[t]:
            top[p // BLOCK] = max(top.get(p // BLOCK, 0.0), x)
        index.blocks.append(top)
        index.bound[i] = impacts.max()
        np.maximum.at(index.groups[i], places // run, impacts.astype(np.float32))
    return index


class _Spellings(dict):
    """A raw piece between white space -> the terms of its words (0: not in the index), of bounded size."""

    def __init__(self, terms):
        self.terms = terms

    def __missing__(self, piece):
        if len(self) >= MEMORY:
            self.clear()
        value = self[piece] = np.array([self.terms.get(w, 0) for w in words(piece)], dtype=np.int32).tobytes()
        return value


def candidates(index: Index, text: str, spell: _Spellings) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, word behind the last, distinct terms) of the passages that can reach the threshold.

    Passages are windows of two halves, each as long as the longest item, so that every place of an
    item lies within a window. A window whose terms' highest impacts sum to less than SHARE, over all items or in
    each run of blocks, is passed over: block-max WAND would find nothing to score in it."""
    terms = np.frombuffer(b"".join(map(spell.__getitem__, text.split())), dtype=np.int32)
    hits = np.flatnonzero(terms)
    if not len(hits):
        return
    half = index.longest
    pairs = np.unique((hits // half).astype(np.int64) << 32 | terms[hits])
    part, term = pairs >> 32, pairs & 0xFFFFFFFF
    halves = np.bincount(part, weights=index.bound[term], minlength=len(terms) // half + 2)
    for k in np.flatnonzero(halves[:-1] + halves[1:] >= SHARE - 1e-6):
        own = np.unique(term[np.searchsorted(part, k) : np.searchsorted(part, k + 2)])
        if len(own) and index.groups[own].sum(axis=0).max() >= SHARE - 1e-5:
            yield int(k * half), int((k + 2) * half), own


def find_items(index: Index, text: str | None, spell: _Spellings) -> list[tuple[int, float, float, float]]:
    """(item id, score, overlap of the question, overlap of the answer) of the items found in a text and
    verified: at least OVERLAP of the shingles of each part are in the passage."""
    if not text or not index.ids:
        return []
    best: dict[int, tuple[float, float, float]] = {}
    flat = None
    for start, stop, terms in candidates(index, text, spell):
        found = index.query(terms)
        if not found:
            continue
        if flat is None:
            flat = [w for piece in text.split() for w in words(piece)]
        seq = flat[start:stop]
        grams = {n: {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} for n in range(1, SHINGLE + 1)}
        for place, score in found:
            share = [len([g for g in part if g in grams[len(g)]]) / len(part) if part else 1.0 for part in (index.question[place], index.answer[place])]
            if min(share) >= OVERLAP:
                best[place] = max(best.get(place, (0.0, 0.0, 0.0)), (min(1.0, score), *share))
    return [(index.ids[p], *best[p]) for p in sorted(best)]


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of about INDEX_BYTES of text each (or one item), made one after the other. Scores don't depend on the cut: they
    take the statistics of all items."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col), F.octet_length(text_col).alias("n"))
    size = rows.agg(F.sum("n")).head()[0] or 0
    shards = max(1, math.ceil(size / INDEX_BYTES))
    whole = all_statistics(rows.select(text_col))
    for k in range(shards):
        yield build_index([(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)) == k).collect()], whole)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: list[str] | None = None) -> DataFrame:
    """A row for each row of ``docs`` and item found in it: ``id_col`` (or the ``key`` columns), ``item_id``,
    ``score`` (BM25 as a share of the item's own), ``question_overlap``, ``answer_overlap``.

    Every passage of every text is a query against the index of all items; all items above the
    threshold are verified. Indexes hold bounded amounts of item text and are broadcast one by one.

    Defined cases: null and empty texts and items without words match nothing; an item without an answer
    (a single word) needs its question only; parts shorter than a shingle count as one shingle of
    their own length; repeated rows of docs match each, repeated items under each of their ids; items
    with a null id are reported as null; empty tables give no rows.
    """
    keys = key or [id_col]
    source, out = docs.select(*keys, F.col(text_col).alias("_text")), None
    for index in indexes(items):
        own = source.select(*keys, F.explode(finder(docs.sparkSession, index)("_text")).alias("_found")).select(*keys, "_found.*")
        out = own if out is None else out.union(own)
    return out


def finder(spark: SparkSession, index: Index):
    """A column function: the items of ``index`` found in a text."""
    shared = spark.sparkContext.broadcast(index)
    names = ("item_id", "score", "question_overlap", "answer_overlap")

    @F.pandas_udf("array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>")
    def find(texts: pd.Series) -> pd.Series:
        index = shared.value
        spell = _Spellings(index.terms)
        return pd.Series([[dict(zip(names, x)) for x in find_items(index, t, spell)] for t in texts])

    return find


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found; columns as they are."""
    for index in indexes(items):
        docs = docs.where(F.size(finder(docs.sparkSession, index)(text_col)) == 0)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
