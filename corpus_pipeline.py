"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

All stages but the last return the columns of ``documents``. Rows go only by a stage's
own decision: texts whose language can't be told; all but the smallest id of each group
of near copies; documents with a benchmark passage. Secrets are masked in place. The
last stage packs what stays into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from textloom.llm.common import checkpoint_dir, read_table, small_batches
from textloom.operators.graph import write
from textloom.session import ship

#: Near copies share at least NEAR_NUM / NEAR_DEN of their shingles of NEAR_WORDS words.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, n=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), action="documents")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, memo=packing.SMALL_MEMO)


def _sized(stage):
    return lambda spark, docs, sf_dir: stage(small_batches(spark), docs, sf_dir)


STAGES = [
    ("language_id", _sized(identify_language)),
    ("ngram_jaccard_join", _sized(drop_near_copies)),
    ("benchmark_decontamination", _sized(drop_contaminated)),
    ("secret_scan", _sized(mask_secrets)),
    ("best_fit_packing", _sized(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared checkpoint folder."""
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        write(out, f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    raise AssertionError("no stage")


#: Byte-pair ids, Bloom filters and Viterbi paths are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None
