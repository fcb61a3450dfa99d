"""The corpus pipeline: good documents, one of each text, one of each group of near copies, mixed by source, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``.

Every stage works on all rows it is given and on whole texts. A null text counts as empty. Rows with a null id pass the
deduplication by near copies and are otherwise rows like others. Repeated rows are one text to the deduplications and rows of
their own elsewhere. Ties go to the smaller id. Further columns are carried along, whatever their names. An empty table gives
an empty table of the same columns.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegraph.core import cut
from tidegraph.llm.bpe import bpe_codes
from tidegraph.llm.common import table
from tidegraph.llm.exact_dedup import exact_dedup
from tidegraph.llm.mixing import mixed_documents
from tidegraph.llm.near_dedup import near_dedup
from tidegraph.llm.quality import keep_good, train_quality

#: SQL can't express the classifier of the first stage; tests compare the stages with plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.5 or more)."""
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles the document with the smallest id."""
    return near_dedup(docs, 5, Fraction(8, 10))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the decoded bytes."""
    return bpe_codes(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
