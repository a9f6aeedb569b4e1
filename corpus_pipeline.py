"""Corpus pipeline: language ID, near-duplicates, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, langid, mixing, neardup, tokens
from lodestone.llm.joins import fresh
from lodestone.shared import forget, materialize

#: A document goes if its calibrated probability is less than this share of the way from chance (one by the number of
#: languages) to certainty: 0.3 with four languages.
ABOVE_CHANCE = 1 / 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter go, and those whose language is hardly likelier than chance
    (ABOVE_CHANCE). Where no row has a label nothing can be learned, and all texts with a letter stay."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    chance = 1 / len(model.languages)
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    judged = langid.predict(docs, model, lang_col=lang, score_col=score)
    return judged.where((judged[lang] != langid.UNDETERMINED) & (judged[score] >= chance + ABOVE_CHANCE * (1 - chance))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more (Jaccard, five words): that with the smallest id.
    SimHash finds links first; a search on prefixes of the shingle sets finds those it can't."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents in token files; what the files say of each."""
    return tokens.tokenize_corpus(spark, docs.select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: Learned models, hashes and tokenizers are beyond SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has read is then deleted.

    Null and empty texts have no language and go at the first stage; equal and near-equal texts leave one row; columns beyond
    those of documents are carried along, whatever their names; an empty table gives no rows."""
    docs = written = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if docs is not written:
            forget(docs)
        docs = after
    return docs
