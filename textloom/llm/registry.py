"""The queries of this subpackage for ``__spark_entry__``."""

from __future__ import annotations

from . import decontaminate, language_id, license_scan, nearest, ngram_join, packing, pii, secret_scan, sharding, token_counts
from .common import read_table, small_batches
from .oracles import ORACLES  # noqa: F401


def op6_sharding(spark, sf_dir):
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark, sf_dir):
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


def op1_pii(spark, sf_dir):
    return pii.report(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return license_scan.report(read_table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.report(read_table(spark, sf_dir, "documents"))


def op4_nearest(spark, sf_dir):
    return nearest.neighbours(read_table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.classes(read_table(spark, sf_dir, "documents"))


_OWN = {"op2_ngram_join": op2_ngram_join, "op4_nearest": op4_nearest, "op3_packing": op3_packing, "op5_token_counts": op5_token_counts, "op7_license_scan": op7_license_scan, "op1_pii": op1_pii, "op9_secret_scan": op9_secret_scan, "op8_language_id": op8_language_id, "op6_sharding": op6_sharding, "op10_decontamination": op10_decontamination}


def _sized(query):
    return lambda spark, sf_dir: query(small_batches(spark), sf_dir)


QUERIES = {name: _sized(query) for name, query in _OWN.items()}
