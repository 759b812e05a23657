"""Documents to token ids: drop toxic texts and near copies, mix sources, encode.

Every stage gets what the stage before kept, written as Parquet and read again.
``STAGES`` are (name, function); a function takes (spark, docs, folder of the tables).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tollgate.llm.common import table
from tollgate.llm.pivotal_mix import mixed_documents
from tollgate.llm.prefix_bpe import encode_documents
from tollgate.llm.signature_join import keep_one_of_each
from tollgate.llm.toxicity import without_toxic
from tollgate.session import written

BYTE_RANKS = "byte_bpe_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, lets pass."""
    return without_toxic(docs, table(spark, folder, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of copies and near copies (five words, 0.75)."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests that prove the round trip."""
    ranks = public_tokenizers.path(BYTE_RANKS)
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("encoding", encoding),
]

# Classifier, random mix and tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"stage_{name}")
    return STAGES[-1][1](spark, docs, folder)
