"""WARC archives and token files: exact round trips and damaged files."""

import base64
import hashlib
import struct
import zlib

import pytest
import zstandard

from lodestone.llm import tokens as tk
from lodestone.llm import warc
from lodestone.shared import new_folder


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_warc(spark):
    pages = [(1, "http://a/", "<p>é"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "u", "<p>é"), (5, "u", "x" * 300_000), (4, "u", "<p>é"), (None, "u", "<p>é"), (-7, "u", "same"), (-9, "u", "same")]
    pages += [(100 + i, "u", "hot") for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "2 AS payload").repartition(3)
    got = warc.read_archives(warc.write_archives(df, new_folder(spark, "warc"))).collect()
    assert len(got) == len(pages)
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -(10**9)), i)
    want = sorted((str(i), len((h or "").encode()), b32((h or "").encode()), "response" if i is None or last[h or ""] == i else "revisit", str(None if i is None or last[h or ""] == i else last[h or ""])) for i, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.read_archives(warc.write_archives(df.limit(0), new_folder(spark, "warc"))).count() == 0


def test_warc_joined_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame([(i, "u", f"t{i % 3}") for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(df, new_folder(spark, "warc"))).collect()}
    assert got == {i: None if i >= 27 else 27 + i % 3 for i in range(30)}


def archive(tmp_path, body, dictionary=b"some words for a dictionary" * 9, squeeze=False, name="x.warc.zst"):
    path = tmp_path / name
    content = zstandard.ZstdCompressor().compress(dictionary) if squeeze else dictionary
    path.write_bytes(struct.pack("<II", warc.DICTIONARY_FRAME, len(content)) + content + body)
    return str(path)


def frame(record, dictionary=b"some words for a dictionary" * 9):
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(record)


def test_warc_damage(tmp_path):
    good = warc.build_record(7, "http://x/", b"body", b32(b"body").encode(), None)
    for squeeze in (False, True):
        (h, payload, n), = warc.read_records(archive(tmp_path, frame(good), squeeze=squeeze))
        assert payload == b"body" and n == 4 and warc.page_of(h[b"warc-record-id"]) == 7
    assert list(warc.read_records(archive(tmp_path, b""))) == []
    bad = [
        frame(good)[:-3], frame(good + b"x"), frame(good + good), frame(good.replace(b"WARC/1.1", b"WORK/1.1")), frame(good.replace(b"WARC-Date", b"WARC Date")),
        frame(good.replace(b"body", b"bodY")), frame(good.replace(b"WARC-Type: response\r\n", b"")), frame(good[:40]), b"\0" * 20, frame(good.replace(b"Content-Length: 4", b"Content-Length: 5")),
    ]
    for body in bad:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(archive(tmp_path, body)))
    plain = tmp_path / "plain.warc.zst"
    plain.write_bytes(zstandard.compress(good) * 2)
    assert len(list(warc.read_records(str(plain)))) == 2


HARD = [None, "", "  \n", "Hello,  WORLD's don't ''s", "ÀÉ ß ẞ İstanbul Σας", "<|endoftext|>x <|startoftext|>", "a\u0301 \u0301b", "日本語 123½ x1y2", "\x1cq\x1f \x85 \xa0z", "a\x00b", "_x_ foo_bar (y)!? \"Hi,\"", "w" * 5000, "e\u0301clair", "ﬁ ½ ²"]


def test_encoder():
    e = tk.encoder(tk.default_tokenizer())
    assert e.by_word
    for text in HARD:
        assert e.encode(text) == (e._whole(text) if text else b"")


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tk, "PER_FILE", 40)
    rows = [(i * 3 - 50, HARD[i % len(HARD)] if i % 5 else f"word{i} " * (i % 60)) for i in range(300)] + [(10, "twice"), (10, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS bucket", "3 AS frame").repartition(3)
    manifest, dictionary = tk.write_tokens(df, new_folder(spark, "tokens"), tk.default_tokenizer())
    assert manifest.count() > 2
    got = sorted(tk.read_tokens(manifest, dictionary).collect(), key=lambda r: r.start)
    t, at = tk.encoder(tk.default_tokenizer()).tokenizer, 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -(10**9) if x is None else x)
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(x)
    for r in got:
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts[r.doc_id]]
        assert r.ids in want and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(struct.pack("<I", i) for i in r.ids))
        at += r.n_tokens
    path = manifest.orderBy("bucket").head().path
    file = tk.TokenReader(path, dictionary)
    assert file.document(len(file) - 1)[0] == [r.doc_id for r in got][len(file) - 1]  # one document, without the others
    with pytest.raises(ValueError):
        tk.TokenReader(path, dictionary + b"x")
    empty, d = tk.write_tokens(df.limit(0), new_folder(spark, "tokens"), tk.default_tokenizer())
    assert tk.read_tokens(empty, d).count() == 0


def test_token_file_damage(spark, tmp_path):
    w = tk.TokenWriter(str(tmp_path), "t", 2, hashlib.sha256(b"").digest())
    w.add(1, 1, zstandard.compress(b"\1\0"))
    path = w.close()[0]
    data = open(path, "rb").read()
    assert tk.TokenReader(path, b"").document(0)[1].tolist() == [1]
    for bad in (data[:-1], data[:20], b"X" + data[1:], data[:-30] + b"\xff" + data[-29:]):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError):
            tk.TokenReader(str(tmp_path / "bad"), b"")


def test_other_tokenizer():
    import public_tokenizers

    e = tk.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word and e.encode("a  b c") == e._whole("a  b c")
