"""A corpus pipeline of five stages: quality, repeated lines, near duplicates, benchmark leaks, packing.

Every stage takes what the stage before kept. The first four return the columns
of ``documents``; packing returns one row per piece. Null texts count as empty
ones and stay unless the classifier rejects them; rows that are equal are copies
of each other, of which the near-duplicate stage keeps one (ties: the smallest
id); further columns pass through whatever their names; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bagminhash, decontam, linedup, packing, quality
from spectraloom.llm.common import free_names, staged
from spectraloom.llm.tokens import default_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (keep,) = free_names(docs, "keep")
    return quality.score_quality(docs, model).where(F.col(keep)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; a document left without words goes too."""
    (gone,) = free_names(docs, "n_deleted")
    d = linedup.drop_repeated_runs(docs)
    d = d.where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return d.withColumn("n_chars", changed).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, default_path())


STAGES = [
    ("quality_classifier", keep_quality), ("line_dedup", drop_repeated_lines), ("near_duplicates", keep_one_of_near_duplicates), ("decontamination", drop_benchmark_leaks), ("packing", pack_sequences),
]
#: SQL cannot train the classifier, walk the signatures or run the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
