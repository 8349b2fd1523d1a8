"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, cotraining, exact_dedup, lattice, line_dedup, mixing, ngram_join, pii, resampling, search, sharding, toxicity, webp
from .common import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


QUERIES = {
    "op1_sharding": lambda spark, sf_dir: sharding.sharding(documents(spark, sf_dir)),
    "op2_quality_classifier": lambda spark, sf_dir: cotraining.quality(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op3_lm_scoring": lambda spark, sf_dir: lattice.lm_scores(documents(spark, sf_dir), lattice.default_path()),
    "op4_mixing": lambda spark, sf_dir: mixing.mixing(documents(spark, sf_dir)),
    "op5_bpe": lambda spark, sf_dir: bpe.encode_documents(documents(spark, sf_dir), bpe.default_path(), "digest"),
    "op6_ngram_jaccard": lambda spark, sf_dir: ngram_join.ngram_join(documents(spark, sf_dir)),
    "op7_toxicity": lambda spark, sf_dir: toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir)),
    "op8_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(documents(spark, sf_dir)),
    "op9_line_dedup": lambda spark, sf_dir: line_dedup.line_report(documents(spark, sf_dir)),
    "op10_media_webp": lambda spark, sf_dir: webp.media_columns(documents(spark, sf_dir)),
    "op11_ranked_search": lambda spark, sf_dir: search.ranked(documents(spark, sf_dir), benchmark(spark, sf_dir)),
    "op12_pii": lambda spark, sf_dir: pii.report(documents(spark, sf_dir)),
    "op13_resampling": lambda spark, sf_dir: resampling.resampled(documents(spark, sf_dir), benchmark(spark, sf_dir)),
}

ORACLE_SQL = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op6_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_ranked_search": search.ORACLE_SQL,
    "op13_resampling": resampling.ORACLE_SQL,
}
