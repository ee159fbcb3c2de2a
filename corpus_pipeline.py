"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; ``run`` writes it as Parquet to the shared working
folder and reads it back for the next stage. All stages but the last return the columns of documents.

* quality: documents that the quality classifier rejects go.
* line_dedup: repeated runs of lines of fifty or more words go wherever they stand later; documents that consist of nothing else go.
* ngram_join: of documents linked by a similarity of at least 0.8 of their five-word shingles one stays, that of the smallest id.
* decontamination: documents that hold a benchmark passage go.
* bpe: number and SHA-256 of the token ids of what is left, and SHA-256 of the bytes that they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import bpe, decontamination, line_dedup, ngram_join, quality
from assaykit.llm.catalog import pattern, vocabulary
from assaykit.llm.common import documents
from assaykit.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``n_chars`` follows the text."""
    found = line_dedup.dedup(docs)
    left = found.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return ngram_join.one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes that they decode to."""
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, pattern())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage), ("line_dedup", line_dedup_stage), ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage), ("bpe", bpe_stage)]
#: Trained trees, edit distances and BPE can't be said in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
