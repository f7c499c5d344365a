"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.decontaminate import without_contaminated
from causeway.llm.language import recognised
from causeway.llm.ngram_join import without_near_copies
from causeway.llm.packing import pack
from causeway.llm.queries import tokenizer
from causeway.llm.substring_dedup import remove_repeats
from causeway.runtime import settled

#: Five words and a similarity of 0.8: the stage's shingles and threshold.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without a letter, and those on which the machines are in doubt throughout."""
    return recognised(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays; rows without words or without an id stay."""
    return without_near_copies(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 35 that occur elsewhere too go; documents of which nothing is left go."""
    out = remove_repeats(docs, 35).where("text <> ''")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in windows of 2048 ids."""
    return pack(docs, tokenizer("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]
#: Support vector machines and online packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
