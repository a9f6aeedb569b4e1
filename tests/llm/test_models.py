"""Language ID, language model, decontamination, near-duplicates and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import decontaminate as dc
from lodestone.llm import embdedup, langid, neardup, pst, simhash
from lodestone.shared import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYL = {"en": ["th", "er", "ing", "and", "wh", "ou"], "fr": ["eau", "que", "é", "oi", "ment", "le"]}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    return [(i, prose("en" if i % 3 else "fr", 5 + i % 60, i), "en" if i % 3 else "fr", f"s{i % 3}", 0) for i in range(n)]


ODD = [(9001, None, "en", None, None), (9002, "", None, "s0", 0), (9003, "12 34 !?", "en", "s0", 8), (9004, "x", None, "s0", 1), (None, "the and", "en", "s0", 1)]


def test_language(spark):
    df = spark.createDataFrame(corpus() + ODD + corpus(3), DOCS).selectExpr("*", "1 AS score", "2 AS label")
    got = langid.identify(df).collect()
    assert len(got) == 248
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 9000:
            assert r.lang_pred == r.lang and 0 < r.score <= 1
    none = langid.fit(df.where("lang is null").select("doc_id", "text", "lang"))
    assert none.predict("text") == ("und", 0.0)
    assert langid.predict(df.limit(0), none).count() == 0


def test_language_parts():
    whole = np.bincount(np.concatenate(list(langid.ngrams("Ab, ab! c" * 40_000))), minlength=langid.BUCKETS)
    assert whole.sum() > 2**19  # texts beyond one piece are read to their end
    logits = np.array([[2.0, 0.0]] * 90 + [[-2.0, 0.0]] * 10)
    t = langid.calibrate(logits, np.zeros(100, int))
    assert abs(1 / (1 + math.exp(-2 / t)) - 0.9) < 0.02
    w, _ = langid.ftrl([(np.array([1, 2]), np.array([1.0, 0.001])), (np.array([3]), np.array([1.0]))] * 50, np.array([0, 1] * 50), 2, l1=0.5)
    assert w[1, 0] > 0 > w[3, 0] and not w[2].any()  # L1 leaves a coordinate of no use at zero


def lm_brute(texts, own_rows):
    """Score of each text by a suffix tree over tuples of words, counted one by one from the rows ``own_rows``."""
    seen, after = Counter(), {}
    for i in own_rows:
        w = pst.tokens(texts[i])
        seen.update(tuple(w[max(0, j - d) : j + 1]) for j in range(len(w)) for d in range(min(j, pst.DEPTH) + 1))
    n, v = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen)
    for g, c in seen.items():
        if len(g) > 1 and c >= 2:
            after.setdefault(g[:-1], {})[g[-1]] = c
    share = lambda g: seen[g] / (seen[g[:-1]] if len(g) > 1 else n)
    stays = {}
    for ctx, nxt in sorted(after.items(), key=lambda x: len(x[0])):
        if len(ctx) > 1 and ctx[1:] not in stays:
            continue
        total, s = seen[ctx], seen[ctx] - sum(nxt.values())
        q = {w: share((*ctx[1:], w)) for w in nxt}
        gain = sum(c * math.log(c / total / q[w]) for w, c in nxt.items())
        gain += s * math.log(s / total / max(1 - sum(q.values()), 1e-9)) if s else 0
        if gain >= pst.DIVERGENCE * total and 2 * gain > len(nxt) + pst.DEVIATIONS * math.sqrt(2 * len(nxt)):
            stays[ctx] = (total, s)

    def p(ctx, w):
        if not ctx:
            return (seen[(w,)] + 1) / (n + v + 1)
        if ctx not in stays:
            return p(ctx[1:], w)
        total, s = stays[ctx]
        return (after[ctx].get(w, 0) + (s + pst.PRIOR) * p(ctx[1:], w)) / (total + pst.PRIOR)

    out = []
    for x in texts:
        w = pst.tokens(x)
        base = sum(math.log10(p((), t)) for t in w)
        out.append((len(w), sum(seen[(t,)] > 0 for t in w), base, sum(math.log10(p(tuple(w[max(0, j - pst.DEPTH) : j]), t)) for j, t in enumerate(w))))
    return n, v, out, stays


@pytest.mark.parametrize("bundle", [500, 1 << 20])
def test_suffix_tree(spark, bundle, monkeypatch):
    """Every score against a suffix tree counted one by one; null, empty, odd, long and repeated texts."""
    monkeypatch.setattr(pst, "BUNDLE", bundle)
    monkeypatch.setattr(pst, "SLICE", 64)
    r = random.Random(7)
    rows = corpus() + ODD + [(7000 + i, "a b c d " * 30, "en", "s", 0) for i in range(30)] + corpus(2)
    rows += [(6000, "once or  \ttwice\u000bthis\x1cwas\u00a0said É é " * 3, "en", "s", 0), (6001, "w" * 300 + " " + "w" * 300, "en", "s", 0)]
    rows += [(6100 + i, " ".join(f"w{int(40 * r.random() ** 2)}" for _ in range(400)), "en", "s", 0) for i in range(20)]
    four = ["u k l m", "v k l n", "u o l r", "v o l t"]
    rows += [(6200 + i, " ".join(r.choice(four) for _ in range(50)), "en", "s", 0) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "lang AS codes", "source AS words", "n_chars AS train")
    bundles = materialize(pst.encode(df, ~pst.held_out()))
    tree = pst.fit(bundles)
    own = [i for i, x in enumerate(rows) if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 7 != 2]
    n, v, want, stays = lm_brute([x[1] for x in rows], own)
    assert (tree.n, tree.v) == (n, v) and set(map(len, stays)) == {1, 2, 3}
    got = sorted((repr(x.doc_id), x.n_tokens, x.n_known, x.base_score, x.score) for x in pst.score(bundles, tree).collect())
    assert len(got) == len(rows)
    for g, w in zip(got, sorted((repr(x[0]), *y) for x, y in zip(rows, want))):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9) and math.isclose(g[4], w[4], rel_tol=1e-6), (g, w)
    score = {i: (s, b) for i, _, _, b, s in got}
    assert score["7000"][0] > score["7000"][1] + 50  # contexts foretell the repeated words


def test_suffix_tree_of_copies(spark):
    """What occurs twice is told apart from what occurs once; the tree grows with the text."""
    r = random.Random(5)
    once = [" ".join(f"w{r.randrange(3000)}" for _ in range(60)) for _ in range(200)]
    texts = once + once[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bundles = materialize(pst.encode(df))
    tree = pst.fit(bundles)
    gain = {x.doc_id: (x.score - x.base_score) / x.n_tokens for x in pst.score(bundles, tree).collect()}
    assert min(gain[i] for i in range(20)) > max(gain[i] for i in range(20, 200)) + 0.5
    half = pst.fit(pst.encode(df.where("doc_id < 110")))
    keys = lambda t: sum(len(x["grams"]) for x in t.packed.collect())
    assert keys(half) < keys(tree)
    empty = pst.fit(pst.encode(df.limit(0)))
    got = pst.score(pst.encode(df.where("doc_id = 3")), empty).head()
    assert (empty.n, got.n_known, got.n_tokens) == (0, 0, 61) and got.score == got.base_score == 0
    assert pst.score(pst.encode(df.limit(0)), tree).count() == 0


def bits(text):
    return simhash.fingerprint(text)


def brute(rows):
    fp, parent = [bits(x) for _, x in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash(spark, monkeypatch):
    base = [prose("en", 400, i) for i in range(60)]
    rows = [(i, x) for i, x in enumerate(base)]
    rows += [(100 + 10 * i + k, base[i] + " extra" * k) for i in range(20) for k in range(3)] + [(900, None), (901, ""), (None, base[3]), (902, "one two"), (100, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS part")
    for shard in (40_000, 10):
        real = simhash.link_fingerprints
        monkeypatch.setattr(simhash, "link_fingerprints", lambda d, r=3, s=shard, f=real: f(d, r, s))
        got = simhash.simhash_components(df).collect()
        monkeypatch.setattr(simhash, "link_fingerprints", real)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute(rows)
    one = simhash.one_of_each(df).collect()
    assert len(one) == len({(f, c) for _, f, c in brute(rows)} and {r.part for r in got})
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_fingerprint_pieces(monkeypatch):
    text = prose("en", 3000, 1)
    whole = bits(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert bits(text) == whole and bits("") == 0 and bits("a b") == simhash.xxhash.xxh64_intdigest(b"a b", 42)


def test_tree_routes():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 900, dtype=np.uint64), np.arange(60, dtype=np.uint64)]))
    want = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3)}
    got = [(max(a, b), min(a, b)) for x, y in simhash.near_pairs(fps, np.zeros(0, np.uint64), 3, 20) for a, b in zip(x.tolist(), y.tolist())]
    assert set(got) == want and len(got) == len(set(got))


@pytest.mark.parametrize("rows_of_a_task", [None, 6])
def test_embeddings(spark, monkeypatch, rows_of_a_task):
    if rows_of_a_task:  # lists beyond it are met block by block
        monkeypatch.setattr(embdedup, "ROWS", rows_of_a_task)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    near = base[:40] + rng.standard_normal((40, 16)) * 0.12
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))] + [(500 + i, base[0].tolist(), 1) for i in range(25)]
    odd = [(800, None, 0), (801, [0.0] * 16, 0), (802, [float("nan")] * 16, 0), (803, [None] + [1.0] * 15, 0), (804, [], 0), (805, [float("inf")] * 16, 0), (806, base[0][:8].tolist(), 0), (None, base[1].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS no", "2 AS many")
    got = {r.vec_id: r for r in embdedup.near_embeddings(df).collect()}
    vec = {r[0]: np.array(r[1]) for r in [*rows, odd[-1]]}
    unit = {k: v / np.linalg.norm(v) for k, v in vec.items()}
    links = {k: {j for j in vec if j != k and unit[k] @ unit[j] >= 0.9} for k in vec}
    for k in vec:
        assert got[k].n_links == len(links[k])
        part, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += links[x]
        least = min(x for x in part if x is not None)
        assert got[k].component_id == least and got[k].kept == (k == least)
    for i in range(800, 807):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embdedup.near_embeddings(df.limit(0)).count() == 0


def test_collision_recall():
    """Pairs right at the threshold: the calibrated counts keep nearly all of them."""
    rng, least, width = np.random.default_rng(3), embdedup.calibrate(), int(embdedup.reach() * embdedup.STEPS) + 1
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    row, lists, values = embdedup.signature(np.concatenate([a, b]))
    size = np.bincount(row, minlength=8000)
    flat, place = np.full((8000, size.max()), -1, np.int16), np.zeros((8000, size.max()), np.int16)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    flat[row, at], place[row, at] = lists, values
    codes = embdedup.coded(flat, place)
    often = embdedup.collisions(np.arange(4000), np.arange(4000, 8000), codes, width, least)
    assert least == 3 and (often >= least).mean() >= 0.999
    far = embdedup.collisions(np.arange(4000), np.roll(np.arange(4000), 1), codes, width, least)
    assert (far >= least).mean() <= 0.002


def test_common_lists(monkeypatch):
    """Each pair with enough common lists comes once, however lists are split."""
    rng = np.random.default_rng(5)
    lists = np.sort(np.array([rng.choice(60, 12, replace=False) for _ in range(120)]), axis=1).astype(np.int16)
    lists[:30] = lists[0]  # a hot group
    lists[rng.random(lists.shape) < 0.1] = -1
    lists = np.sort(np.where(lists < 0, 99, lists), axis=1)
    lists[lists == 99] = -1
    draw = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = [set(x[x >= 0].tolist()) for x in lists]
    want = Counter((i, j) for j in range(120) for i in range(j) if len(sets[i] & sets[j]) >= 3)
    for dense, tile in ((512, 1024), (5, 7), (40, 16)):
        monkeypatch.setattr(embdedup, "DENSE", dense)
        monkeypatch.setattr(embdedup, "TILE", tile)
        got = Counter()
        for k in range(60):
            members = np.flatnonzero((lists == k).any(axis=1))
            for i, j in embdedup.windows(members, [k], lists, draw, 3) if len(members) > 1 else ():
                got.update((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()))
        assert got == want


def items(n=60):
    return [(i, prose("en" if i % 2 else "fr", 14, 1000 + i) + ".\n" + prose("en", 8, 2000 + i) + ".") for i in range(n)]


def test_decontamination(spark):
    bench = items() + [(900, None), (901, "..."), (902, "lonely"), (None, prose("fr", 30, 77))]
    docs = [(i, prose("en", 150, i)) for i in range(40)]
    planted = {i: i for i in range(0, 40, 3)}
    docs = [(i, x[:300] + " " + bench[planted[i]][1].upper().replace(".", " !") + " " + x[300:] if i in planted else x) for i, x in docs]
    docs += [(100, None), (101, ""), (102, bench[1][1].split("\n")[0]), (None, bench[2][1]), (103, bench[4][1]), (103, bench[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score").drop("item_id", "score")
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(df, spark.createDataFrame(bench, "item_id long, text string")).collect())
    assert got == Counter([*planted.items(), (None, 2), (103, 4), (103, 4)])
    left = dc.without_items(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - set(planted) - {None, 103}
    assert dc.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_shards(spark, monkeypatch):
    monkeypatch.setattr(dc, "INDEX_BYTES", 700)
    bench = items()
    docs = [(i, prose("en", 80, 5000 + i) + " " + x) for i, x in bench]
    def scores():
        got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        return {(r.doc_id, r.item_id): r.score for r in got.collect()}

    parts = scores()
    assert sorted(parts) == [(i, i) for i, _ in bench]
    monkeypatch.undo()
    assert scores() == pytest.approx(parts)  # however items are cut into indexes


def test_block_max_wand():
    index = dc.build_index([(i, prose("en" if i % 2 else "fr", 6 + i % 20, i)) for i in range(150)])
    rng = np.random.default_rng(4)
    for _ in range(200):
        terms = np.unique(rng.integers(1, len(index.postings), 25))
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.postings[t][0]] += index.postings[t][1]
        for share in (0.05, 0.3, 0.6):
            assert {p for p, _ in index.query(terms, share)} == set(np.flatnonzero(scores >= share - 1e-9).tolist())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    bench = items(5)
    docs = corpus(120) + ODD + [(3000 + i, corpus(120)[50][1], "en", "s0", 0) for i in range(20)] + [(4000, prose("en", 60, 1) + " " + bench[3][1], "en", "s1", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen[name] = [r.doc_id for r in df.collect()]
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert not {9001, 9002, 9003} & set(seen["language"]) and set(range(120)) <= set(seen["language"])
    assert not set(range(3000, 3020)) & set(seen["near_duplicates"]) and 50 in seen["near_duplicates"]
    assert 4000 in seen["near_duplicates"] and 4000 not in seen["decontamination"]
    out = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(seen["source_mix"])


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame(items(5), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = "_lang, _score, _judged, _row, _place, _times, _whole, tokens, shard".split(", ")
    texts = [(i, prose("en", 40, 300 + i), None, "s0", 0) for i in range(12)] + [(50, None, None, None, 0), (51, "12 34", None, "s1", 0), (52, prose("fr", 9000, 7), None, "s1", 0)]
    texts += [texts[0], (None, prose("en", 40, 900), None, None, None)]
    docs = spark.createDataFrame(texts, DOCS).selectExpr("*", *[f"concat('x', doc_id) AS {c}" for c in clash])
    for name, stage in cp.STAGES[:-1]:  # no label: nothing is learned, and what has a letter stays
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")] + clash, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        assert {r.doc_id for r in got} == {*range(12), 52, None}, name
        assert all(r[c] == (r.doc_id if r.doc_id is None else f"x{r.doc_id}") for r in got for c in clash), name
    docs.limit(0).select(*docs.columns[:5]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_edited_copies(spark, tmp_path):
    import corpus_pipeline as cp

    r, docs = random.Random(3), []
    for i in range(60):
        words = prose("en", 120, 1000 + i).split()
        docs.append((i, " ".join(words), "en", "s0", 0))
        for k in range(3):
            for _ in range(1 + i % 6):
                words[r.randrange(len(words))] = f"edit{r.random()}"
            docs.append((100 + 3 * i + k, " ".join(words), "en", "s0", 0))
    docs += [(900, None, "en", "s0", 0), (901, "", "en", "s0", 0), (902, "a b", "en", "s0", 0), (903, "A  b", "en", "s0", 0), (None, "a b", "en", "s0", 0)]
    grams = {d[0]: {tuple(w[j : j + 5]) for w in [(d[1] or "").lower().split()] for j in range(max(1, len(w) - 4))} for d in docs}
    root = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) and root[a] != root[b]:
                old, new = sorted((root[a], root[b]), key=lambda x: (x is None, x))[::-1]
                root = {k: new if v == old else v for k, v in root.items()}
    want = set(root.values())
    assert 60 < len(want) < 200
    got = [x.doc_id for x in cp.near_duplicates(spark, spark.createDataFrame(docs, DOCS), str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_maps_lose_no_pair():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 250, 1500, 9000):
        base = r.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [np.unique(base)]
        for gone in r.integers(0, max(2, n // 4), 25):
            sets.append(np.unique(np.concatenate([base[gone:], r.integers(0, 1 << 63, r.integers(0, gone + 1)).astype(np.uint64)])))
        own = [(len(s), neardup.parity(s)) for s in sets]
        rows = {"row": range(len(sets)), "n": [x[0] for x in own], "place": 0, "part": range(len(sets)), "side": 0, "bits": [x[1] for x in own], "cross": False}
        found = {(a, b) for x in neardup.met(pd.DataFrame(rows)) for a, b in zip(*(np.broadcast_to(y, np.broadcast_shapes(x[0].shape, x[1].shape)) for y in x))}
        pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
        near = {p for p in pairs if neardup.alike(sets[p[0]], sets[p[1]])}
        may = {p for p in pairs if neardup.may_be_alike(own[p[0]], own[p[1]])}
        assert near <= found <= may and (n != 250 or 0 < len(near) and len(may) < len(pairs))


@pytest.mark.parametrize("block", [8192, 20])
def test_near_duplicates_of_a_crowd(spark, monkeypatch, block):
    """Many texts that share rare shingles and are yet apart don't meet as pairs of rows; those alike are found."""
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    made, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: made.append((name, out := write(df, name), out.count() if name == "near-pairs" else 0)) or out)
    r, docs, base = random.Random(8), [], prose("en", 200, 77).split()
    for i in range(90):
        words = docs[i - 80][1].split() if i >= 80 else list(base)
        for at in r.sample(range(200), 1 if i >= 80 else 4):
            words[at] = f"edit{r.random()}"
        docs.append((i, " ".join(words), "en", "s0", 0))
    sets = [neardup.shingles(d[1]) for d in docs]
    pairs = [(a, b) for b in range(90) for a in range(b) if neardup.alike(sets[a], sets[b])]
    root = list(range(90))
    for a, b in pairs:
        old, new = sorted((root[a], root[b]))[::-1]
        root = [new if x == old else x for x in root]
    assert 1 < len(set(root)) < 90
    got = [x.doc_id for x in neardup.one_of_each(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got) == sorted(set(root))
    assert sum(many for _, _, many in made) < 500  # of 4005
