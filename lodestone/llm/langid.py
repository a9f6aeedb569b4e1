"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.joins import fresh

#: Hash buckets of n-grams, their lengths, characters handled at once.
BUCKETS, LENGTHS, PIECE = 1 << 16, (1, 2, 3), 1 << 18
#: Labelled documents of each language that the model is trained on, in expectation (the bound on the
#: sample); a share of them is kept for calibration.
PER_LANGUAGE, CALIBRATION = 1500, 0.2
#: Languages at most; more are refused, not dropped.
MOST_LANGUAGES = 500
UNDETERMINED = "und"
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of the whole lower-cased text, piece by piece. Runs of
    characters that aren't letters count as one space."""
    text = " " + " ".join(re.sub(r"[\W\d_]+", " ", text.lower()).split()) + " "
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + max(LENGTHS) - 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, max(LENGTHS) + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :]) * _PRIMES[n - 1]
            if n in LENGTHS and len(h):
                own = h[: min(len(h), PIECE)]
                yield ((own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.intp)


@dataclass
class Model:
    """``table``: IDF times weight for each bucket and language, so that the mean over a text's n-grams is
    its logit for TF-IDF features with relative frequencies; ``bias``; ``temperature``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in ngrams(text):
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 4, seed: int = 5):
    """Weights (BUCKETS, k) and bias (k,) by FTRL-proximal: a per-coordinate learning rate, and the elastic
    net (``l1``, ``l2``) inside the leader's closed form, which leaves coordinates of little use at zero."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for d in rng.permutation(len(features)):
            idx, val = features[d]
            idx, val = np.append(idx, BUCKETS), np.append(val, 1.0)  # the last coordinate is the bias
            w = weights(idx)
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[d]] -= 1.0
            g = val[:, None] * p
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood (golden section over its logarithm)."""
    if not len(logits):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    a, b, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 11) -> Model:
    """Train on the rows of ``docs``; only ``text_col`` and ``label_col`` are learned from.

    Document frequencies count every labelled row. The weights are fitted on a sample of about
    ``per_language`` rows of each language (rows whose hashed id falls under the language's share), of
    which a fifth only calibrates the temperature. The sample's features are computed and the model is
    fitted in one task; it returns BUCKETS weights for each language.

    Rows with a null label or a text without a letter are left out. No such rows at all: a model
    without languages, which answers ``und``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    docs = docs.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(docs.groupBy("label").count().limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    languages, rows = sorted(counts), sum(counts.values())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, seen = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for text in batch["text"]:
                for h in ngrams(text):
                    seen[h] = True
                df += seen
                seen[:] = False
        found = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": found, "df": df[found]})

    found = docs.select("text").mapInPandas(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS)
    df[found["bucket"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0

    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < share
    sample = docs.where(drawn).select("text", "label", F.xxhash64("id", F.lit(seed + 1)).alias("order"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                tf = np.zeros(BUCKETS)
                for h in ngrams(text):
                    tf += np.bincount(h, minlength=BUCKETS)
                idx = np.flatnonzero(tf)
                out.append((idx.astype(np.int32).tobytes(), (tf[idx] / tf.sum() * idf[idx]).astype(np.float32).tobytes()))
            yield pd.DataFrame({"label": batch["label"], "order": batch["order"], "idx": [x[0] for x in out], "val": [x[1] for x in out]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["order"], b["label"], b["idx"], b["val"])]
        rows.sort()
        labels = np.array([languages.index(r[1]) for r in rows], dtype=np.int64)
        feats = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32).astype(float)) for r in rows]
        held = max(1, int(CALIBRATION * len(rows))) if len(rows) >= 10 else 0
        w, bias = ftrl(feats[held:], labels[held:], len(languages))
        logits = np.array([v @ w[i] + bias for i, v in feats[:held]]).reshape(held, len(languages))
        yield pd.DataFrame({"w": [(w * idf[:, None]).astype(np.float32).tobytes()], "bias": [bias.tobytes()], "t": [calibrate(logits, labels[:held])]})

    coded = sample.mapInPandas(features, "label string, order long, idx binary, val binary")
    got = coded.repartition(1).mapInPandas(learn, "w binary, bias binary, t double").head()
    table = np.frombuffer(got["w"], np.float32).reshape(BUCKETS, len(languages))
    return Model(languages, table, np.frombuffer(got["bias"]), got["t"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its calibrated probability; ``und`` and 0
    for a null text and one without a letter. Columns of those two names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats
    docs = docs.drop(*[c for c in (lang_col, score_col) if c in docs.columns])

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    judged = fresh(docs, "_judged")
    out = docs.withColumn(judged, judge(F.col(text_col)))
    return out.select(*docs.columns, F.col(judged).lang.alias(lang_col), F.col(judged).score.alias(score_col))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text has the remainder 0 by 5; a row with a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """The documents table with ``held_out``, ``lang_pred`` and ``score``; learned from the rest."""
    model = fit(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
