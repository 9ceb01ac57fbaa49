"""The text pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of the documents, which is written as Parquet and
read again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platewise.llm.common import shared, table
from platewise.llm.cotraining import keep_good
from platewise.llm.mixing import emit
from platewise.llm.packing import pack
from platewise.llm.resemblance import keep_first
from platewise.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id: five-word shingles, a resemblance
    of 0.8 or more."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the target weights of their sources ask for."""
    return emit(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids, with the ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("secret scans", secrets),
          ("mixing sources", mixing), ("packing", packing)]

#: Training a classifier, fingerprints and tokenizing are not SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
