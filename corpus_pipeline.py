"""Five stages from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame, which is written to the shared folder as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.llm.common import documents, saved, small
from gaplens.llm.line_dedup import dedup_lines
from gaplens.llm.ngram_join import ngram_components
from gaplens.llm.quality_rules import keep_quality
from gaplens.llm.raking import mix_sources
from gaplens.llm.sentencepiece_nbest import decode_column, encode_column


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs, documents(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    kept = dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of least id. Shingles of five words, similarity 0.8."""
    found = ngram_components(docs, shingle=5, percent=80)
    gone = saved(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small(gone, 16), F.col("doc_id") == F.col("__gone"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target weights."""
    return mix_sources(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text that is left, whether they decode to it, and its n best segmentations."""
    decoded = decode_column(encode_column(docs.select("doc_id", "text"), digest=True))
    return decoded.select("doc_id", F.size("ids").alias("n_pieces"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "nbest_sha256", F.transform("nbest_scores", lambda x: F.round(x, 4)).alias("nbest_scores"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("source_mixing", mixing),
    ("sentencepiece", encoding),
]

#: SQL cannot express the certified cutoffs and the segmentation: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
