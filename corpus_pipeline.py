"""Corpus pipeline: language, quality, near copies, personal data, packing; each stage is written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Texts that a stage rejects are gone for the next one, and the next one sees its changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import ngramjoin, pii, ppm, quality, registry
from gridlake.llm.common import documents, written
from gridlake.llm.packing import Bins, pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the trees learned; null texts and texts without letters go.

    A row with a null id is no training row but is told like the others; repeated rows repeat; no rows give
    none. Columns of docs pass through whatever their names.
    """
    train = ~F.coalesce(registry.held_out(), F.lit(False))
    model = ppm.train(docs, train)
    told = ppm.predict(docs, model, keep=docs.columns, pred_col="__lang_pred", score_col="__lang_score")
    return told.where(F.col("__lang_pred") != ppm.UNKNOWN).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that no rule of the cascade rejects; a null or empty text has too few words.

    Ids aren't read; repeated rows repeat; no rows give none; other columns pass through.
    """
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by shingles of five words at a Jaccard similarity of 0.8 or more."""
    return ngramjoin.keep_one(docs, shingle=5, threshold=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the kind in brackets; n_chars follows the new text, where docs has it.

    A null text stays null, with a null n_chars. Ids aren't read; repeated rows repeat; no rows give none;
    other columns pass through.
    """
    clean = pii.redact(pii.find(docs, pii.fit(docs), base_col="__pii_base", spans_col="__pii_spans"), spans_col="__pii_spans")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into sequences of at most 2048."""
    return pack_documents(docs, registry.tokenizer_path("word_bpe_49k.json"), Bins(2048))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trees, shingle joins and tokenizers can't be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
