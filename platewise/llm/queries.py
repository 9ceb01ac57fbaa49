"""The queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from .alignment import alignment_report
from .ann import search
from .common import table
from .cotraining import classify
from .imatch import fingerprints
from .lexical import ranked_search
from .licenses import scan_licenses
from .mixing import mix
from .packing import pack
from .ppm import score_documents
from .rans import read_ids, write_ids
from .secrets import scan
from .simhash import near_duplicates
from .stream_dedup import deduplicate


def op1_simhash_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates(table(spark, base, "documents"))


def op2_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    return score_documents(table(spark, base, "documents"))


def op3_packing(spark: SparkSession, base: str) -> DataFrame:
    return pack(table(spark, base, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_token_files(spark: SparkSession, base: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_ids(table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, f"{path}-unordered")
    return read_ids(spark, path, with_ids=False)


def op5_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    return classify(table(spark, base, "documents"), table(spark, base, "labels"))


def op6_document_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return fingerprints(table(spark, base, "documents"))


def op7_license_scans(spark: SparkSession, base: str) -> DataFrame:
    return scan_licenses(table(spark, base, "documents"))


def op8_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    return mix(table(spark, base, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scans(spark: SparkSession, base: str) -> DataFrame:
    return scan(table(spark, base, "documents"))


def op10_nearest_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return search(table(spark, base, "embeddings"))


def op11_lexical_search(spark: SparkSession, base: str) -> DataFrame:
    return ranked_search(table(spark, base, "documents"), table(spark, base, "benchmark"))


def op12_cross_tokenizer(spark: SparkSession, base: str) -> DataFrame:
    return alignment_report(table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_stream_dedup(spark: SparkSession, base: str) -> DataFrame:
    return deduplicate(spark, f"{base}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_lm_scoring, op3_packing, op4_token_files, op5_quality_classifier, op6_document_fingerprints, op7_license_scans, op8_mix_sources, op9_secret_scans, op10_nearest_neighbours,
    op11_lexical_search, op12_cross_tokenizer, op13_stream_dedup)}
