"""A training corpus from raw documents: each stage is an operator, written and read again before the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolumen.llm import catalog, mixing, quality, secret_scan, similar
from repolumen.llm.common import fresh, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    mark = fresh(docs, "quality")
    return quality.quality_rules(docs, into=mark).filter(f"{mark}.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by 0.8 or more of their runs of five words, the smallest id stays.

    SimHash fingerprints within two bits propose links, MinHash bands further ones; the runs decide.
    """
    return similar.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and its length is counted anew; no document goes."""
    return secret_scan.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mark = fresh(docs, "mix")
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), mixing.letter_share(F.col("text")), into=mark)
    times = F.explode(F.sequence(F.lit(1), F.col(f"{mark}.copies")))
    return mixed.filter(f"{mark}.copies > 0").select(*docs.columns, times.alias(fresh(mixed, "time"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return catalog.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot state the fingerprints and tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
