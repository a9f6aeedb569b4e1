"""Token-ID files: each document compressed on its own with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm.files import FileWriter, open_input, train
from lodestone.shared import materialize, new_folder

MAGIC, FOOTER = b"LTOK1\n", b"LTOKEND\n"
END_ID = 1
#: Documents whose ids train the dictionary, its size, documents of a file, and files at most.
SAMPLE, DICTIONARY_BYTES, PER_FILE, MOST_FILES = 256, 64 << 10, 8000, 20_000
#: Entries that a worker's memory of encoded words holds before it starts anew.
MEMORY = 500_000

#: Fixed values of the tokenizers for which words can be encoded on their own: white space only separates
#: and is dropped, and a word is a run of letters, one digit, or a run of other characters.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Memory(dict):
    """bytes -> serialized ids, filled on demand, of bounded size."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Texts to serialized ids with a tokenizer of the ``tokenizers`` library.

    For a tokenizer that drops white space and takes words apart (see WORD_PATTERN), pieces between ASCII
    white space are encoded on their own and remembered: the ids of a text are those of its pieces in
    turn. A piece of plain letters between punctuation goes to the library's BPE model directly. Any
    other tokenizer encodes whole texts.
    """

    PIECE = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        normal, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        self.by_word = (
            normal.get("normalizers") == WORD_NORMALIZERS
            and first.get("pattern") == {"Regex": WORD_PATTERN}
            and first.get("behavior") == "Removed"
            and config.get("post_processor") is None
            and not any(re.search(r"\s", t["content"]) or t["normalized"] for t in config.get("added_tokens", []))
        )
        self.pieces, self.words = _Memory(self._piece), _Memory(self._word)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE writes as themselves
        rest = [b for b in range(256) if b not in plain]
        self.table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.table)
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], dtype=self.type).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        found = self.PIECE.fullmatch(text)
        if not found:
            return self._whole(text)
        before, word, after = found.groups()
        out = self.words[word.lower()]
        if before or after:
            out = (before and self.pieces[before.encode()]) + out if before else out
            out = out + self.pieces[after.encode()] if after else out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.encode("utf-8", "replace").split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class TokenWriter:
    """One file: magic, width of an id, SHA-256 of the dictionary; a frame for each document; an index of
    (document id, has an id, tokens, offset); a footer with the place of the index and its CRC-32."""

    def __init__(self, folder: str, name: str, width: int, dictionary_hash: bytes):
        self.file, self.index, self.tokens = FileWriter(folder, name), [], 0
        self.file.write(MAGIC + struct.pack("<B", width) + dictionary_hash)

    def add(self, doc: int | None, n: int, frame: bytes) -> None:
        self.index.append(struct.pack("<q?qQ", doc or 0, doc is not None, n, self.file.bytes))
        self.tokens += n
        self.file.write(frame)

    def close(self) -> tuple[str, int, int]:
        index, at = b"".join(self.index), self.file.bytes
        self.file.write(index + struct.pack("<QQI", at, len(self.index), zlib.crc32(index)) + FOOTER)
        return self.file.close(), len(self.index), self.tokens


class TokenReader:
    """Documents of a file by their place, each decoded alone. The dictionary's hash, the index's CRC and
    every length are checked; ValueError tells what doesn't fit."""

    ENTRY, TAIL, HEAD = struct.Struct("<q?qQ"), struct.Struct("<QQI"), len(MAGIC) + 33

    def __init__(self, uri: str, dictionary: bytes):
        self.stream = open_input(uri)
        size = self.stream.size()
        head = self.stream.read(self.HEAD)
        if head[: len(MAGIC)] != MAGIC or size < self.HEAD + self.TAIL.size + len(FOOTER):
            raise ValueError(f"{uri}: not a token file")
        self.width = head[len(MAGIC)]
        if head[len(MAGIC) + 1 :] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.stream.seek(size - self.TAIL.size - len(FOOTER))
        tail = self.stream.read(self.TAIL.size + len(FOOTER))
        if tail[self.TAIL.size :] != FOOTER:
            raise ValueError(f"{uri}: cut off")
        self.at, count, crc = self.TAIL.unpack(tail[: self.TAIL.size])
        self.stream.seek(self.at)
        index = self.stream.read(count * self.ENTRY.size)
        if len(index) != count * self.ENTRY.size or zlib.crc32(index) != crc:
            raise ValueError(f"{uri}: the index is damaged")
        self.index = [*self.ENTRY.iter_unpack(index)]
        self.uri, self.zstd = uri, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        doc, known, n, at = self.index[i]
        end = self.index[i + 1][3] if i + 1 < len(self.index) else self.at
        if at != self.stream.tell():
            self.stream.seek(at)
        ids = np.frombuffer(self.zstd.decompress(self.stream.read(end - at)), dtype=f"<u{self.width}")
        if len(ids) != n:
            raise ValueError(f"{self.uri}: document {i} has {len(ids)} ids, its index says {n}")
        return doc if known else None, ids

    def close(self) -> None:
        self.stream.close()


def dictionary_for(docs: DataFrame, rows: int, path: str, id_col: str, text_col: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """The shared dictionary, trained on the ids of about ``sample`` of the ``rows`` documents (drawn by a hash of
    the id, 4 * ``sample`` at most). It only makes the files smaller; ids never depend on it."""
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, rows))))
    tool = encoder(path)
    texts = docs.where(drawn).select(F.col(text_col).alias("t")).limit(4 * sample).collect()
    return train([tool.encode(r["t"]) + np.array([end_id], tool.type).tobytes() for r in texts], DICTIONARY_BYTES)


def write_tokens(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, level: int = 3
) -> tuple[DataFrame, bytes]:
    """Encode every text, append ``end_id`` and write files in ascending order of the id.

    Returns the manifest (``bucket``, ``path``, ``docs``, ``tokens``) and the dictionary. Documents are
    encoded and compressed where they are read; only compressed documents are shuffled, by ranges of
    the id from its quantiles, sorted within a task and streamed to its files.

    Defined cases: null and empty texts have the end id only; a null id comes first; repeated ids stay, one
    after the other (by length, then content); an empty table gives no file.
    """
    rows = docs.count()
    files = max(1, min(MOST_FILES, rows // PER_FILE))
    dictionary = dictionary_for(docs, rows, path, id_col, text_col, end_id)
    key = hashlib.sha256(dictionary).digest()
    saved = FileWriter(folder, f"dictionary-{key.hex()}")
    saved.write(dictionary)
    saved.close()
    bounds = docs.select(F.percentile_approx(id_col, [i / files for i in range(1, files)] or [0.5], 10 * files).alias("q")).head()["q"]
    bounds = np.unique(np.array(bounds or [], dtype=np.int64))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path)
        end = np.array([end_id], tool.type).tobytes()
        zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            counts, frames = [], []
            for text in batch["text"]:
                ids = tool.encode(text) + end
                counts.append(len(ids) // tool.width)
                frames.append(zstd.compress(ids))
            known = ~batch["missing"]
            bucket = np.where(known, np.searchsorted(bounds, batch["id"].to_numpy(), "right"), 0)
            yield pd.DataFrame({"bucket": bucket, "missing": batch["missing"], "id": batch["id"], "n": counts, "frame": frames})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, now, out, done = encoder(path).width, None, None, []
        for batch in batches:
            for bucket, missing, doc, n, frame in zip(batch["bucket"], batch["missing"], batch["id"], batch["n"], batch["frame"]):
                if bucket != now:
                    if out:
                        done.append((now, *out.close()))
                    now, out = bucket, TokenWriter(folder, f"tokens-{bucket:06d}", width, key)
                out.add(None if missing else int(doc), int(n), bytes(frame))
        if out:
            done.append((now, *out.close()))
        yield pd.DataFrame(done, columns=["bucket", "path", "docs", "tokens"])

    source = docs.select(F.col(id_col).isNull().alias("missing"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(text_col).alias("text"))
    coded = source.mapInPandas(encode, "bucket int, missing boolean, id long, n long, frame binary")
    parts = max(1, min(files, 4096))
    coded = coded.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("missing"), "id", "n", "frame")
    return materialize(coded.mapInPandas(write, "bucket int, path string, docs long, tokens long"), "token-manifest"), dictionary


def read_tokens(manifest: DataFrame, dictionary: bytes, ids: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and ids (if asked for)."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch["path"], batch["start"]):
                file, rows, held, start = TokenReader(uri, dictionary), [], 0, int(start)
                for i in range(len(file)):
                    doc, found = file.document(i)
                    rows.append((doc, start, len(found), zlib.crc32(found.astype("<u4").tobytes()), found.astype("int32") if ids else None))
                    start += len(found)
                    held += 8 * len(found) * ids + 100
                    if held > 8 << 20:
                        yield _frame(rows)
                        rows, held = [], 0
                file.close()
                yield _frame(rows)

    return files.repartition(max(1, min(10_000, manifest.count())), "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_corpus(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) to token files in the shared folder and read them back."""
    manifest, dictionary = write_tokens(docs, new_folder(spark, "tokens"), path or default_tokenizer())
    return read_tokens(manifest, dictionary, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_token_output": op10_token_output}
ORACLES: dict[str, str] = {}
