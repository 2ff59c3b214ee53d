"""Corpus pipeline: language, near duplicates, personal data, packing; each stage works on what the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from choicefield.llm import langid, ngram_join, packing, pii
from choicefield.llm.common import Stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIZE, PERCENT = 5, 80  # near duplicates share this many per cent of their five-word shingles
ORACLE_SQL = None  # no SQL expresses a language model, byte-level BPE or this packing; tests compare with brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; the models learn from the training rows of ``docs`` itself."""
    docs = docs.select(COLUMNS)
    return langid.accepted_rows(docs, langid.train(docs.filter(~langid.is_held_out("doc_id") & docs.doc_id.isNotNull())))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; documents without words all stay. Rows are told
    apart by their shingles and not by their ids, so unlike documents under a null or repeated id all stay too."""
    return ngram_join.one_per_component(docs.select(COLUMNS), SIZE, PERCENT)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind in brackets."""
    return pii.redact(docs.select(COLUMNS), "text", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("personal_data", no_personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
