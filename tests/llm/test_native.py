"""Sharding, mixing and URL filters against their definitions."""

import zlib
from collections import Counter, defaultdict

from lodestone.llm.mixing import mix_sources, mixed_rows, op7_mixing
from lodestone.llm.sharding import interleave_shards, op5_sharding
from lodestone.llm.urlfilter import filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows, schema=DOCS, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def docs(n, hot=0.6):
    out = [(i, "w " * (i % 7) + "é", "en", "big" if i < n * hot else f"s{i % 4}", 1) for i in range(n)]
    return out + [(n, None, None, None, None), (n + 1, "", "en", None, 0), (5, "w w", "en", "big", 3), (5, "w w", "en", "big", 3), (None, "x", "en", "big", 1)]


def test_sharding(spark, tmp_path):
    rows = docs(3000)
    got = op5_sharding(spark, table(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = {(r.doc_id, r.size, r.shard, r.slot) for r in op5_sharding(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.size, r.shard, r.slot) for r in got}


def test_sharding_mixture(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(1600)]
    got = interleave_shards(spark.createDataFrame(rows, "doc_id long, source string"), keep={}).collect()
    for shard in range(16):
        own = [r for r in got if r.shard == shard]
        assert abs(sum(r.stratum == "0small" for r in own) - len(own) / 3) <= 2


def test_sharding_small(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert interleave_shards(empty).count() == 0
    got = interleave_shards(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, source string")).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (8, 0)]


def fill(sizes, weights, share=1.5, epochs=2):
    caps, total, full = [epochs * s for s in sizes], share * sum(sizes), set()
    while True:
        rest, w = total - sum(caps[i] for i in full), sum(x for i, x in enumerate(weights) if i not in full)
        target = [caps[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and target[i] > caps[i]}
        if not above:
            return target
        full |= above


def test_mixing(spark, tmp_path):
    rows = docs(3000)
    got = op7_mixing(spark, table(spark, tmp_path, rows)).collect()
    by = defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        by[source[r.doc_id]].append(r)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((k for k in by if k is not None), key=lambda k: k.encode()) + [None]
    sizes = [sum(r.size for r in by[k]) for k in names]
    for k, size, target in zip(names, sizes, fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])):
        assert {r.source_size for r in by[k]} == {size}
        assert all(abs(r.target - target) < 1e-6 * max(1, target) for r in by[k])
        assert abs(sum(r.taken for r in by[k]) - target) <= 0.51
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op7_mixing(spark, str(tmp_path)).collect()), key=str) and sorted(got, key=key)


def test_mixing_rows(spark):
    df = spark.createDataFrame(docs(400), DOCS).selectExpr("*", "1 AS size", "2 AS taken")
    out = mixed_rows(df)
    assert out.columns == df.columns
    times = Counter(r.doc_id for r in out.collect())
    assert max(v for k, v in times.items() if k != 5) <= 2 and None in {r.doc_id for r in mix_sources(df).collect()}
    assert mixed_rows(df.limit(0)).count() == 0


def test_all_sources_full(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t")], "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mix_sources(df, share=5.0).collect()} == {1: 4, 2: 2}


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = max(((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG/", "http://org", "https://a.b.Example.org/es/x?q#f", "http://xexample.org/es/", "http://example.org/en/123",
        "http://example.org/en/2", "x://y.com/fr/", "x://com/de/", "http://com.de/", "http://a.com?/fr/", "a://b://c.org/", "http://..org/x", "http://É.org/\n?x", "http://u@h.com:80/de/",
    ]
    rows = [(i, u, "x") for i, u in enumerate(urls + urls[6:8])]
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, verdict string")
    for keep in (True, False):
        import lodestone.llm.urlfilter as m

        old, m.BROADCAST_ROWS = m.BROADCAST_ROWS, m.BROADCAST_ROWS if keep else 0
        got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
        m.BROADCAST_ROWS = old
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {r[0]: judge(r[1]) for r in rows} and len(got) == len(rows)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), empty).collect()} == {"allow"}


def test_url_lists(spark):
    """Thousands of listed prefixes: the filter's false positives never reach the result."""
    rules = [(f"h{i}.net", f"/p{i}/", "block") for i in range(3000)]
    pages = [(i, f"http://www.h{i}.net/p{i if i % 2 else i + 1}/x") for i in range(3000)]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got)
