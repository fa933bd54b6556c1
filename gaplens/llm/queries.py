"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.llm.common import documents
from gaplens.llm.conversation_repair import repair_conversations
from gaplens.llm.html_wrappers import extract_main
from gaplens.llm.licenses import scan_licenses
from gaplens.llm.line_dedup import dedup_lines
from gaplens.llm.media import media_column, media_features
from gaplens.llm.ngram_join import ngram_components
from gaplens.llm.oracles import ORACLES
from gaplens.llm.quality_rules import quality_verdicts
from gaplens.llm.quality_trees import score_quality
from gaplens.llm.raking import mix_weights
from gaplens.llm.sentence_spans import dedup_runs
from gaplens.llm.sentencepiece_nbest import decode_column, encode_column
from gaplens.llm.source_divergence import source_divergence
from gaplens.llm.toxic_passages import score_toxicity


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_column(encode_column(documents(spark, sf_dir).select("doc_id", "text"), digest=True))
    return decoded.select("doc_id", "nbest_sha256", F.size("ids").alias("n_pieces"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), F.transform("nbest_scores", lambda x: F.round(x, 4)).alias("nbest_scores"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_runs(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_sentences").alias("n_sentences"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_weights(documents(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(documents(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: 2000 ids make a directory under their source with three below it; one document in ten is a licence file.
    step = F.floor(F.col("doc_id") / 20)
    is_file = step % 10 == 0
    name = F.when(is_file, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 2000).cast("string"), F.when(~is_file, (step % 3).cast("string")), name)
    return scan_licenses(documents(spark, sf_dir).withColumn("path", path))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(media_column(documents(spark, sf_dir).select("doc_id", "text")))
    return found.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile", "error")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(documents(spark, sf_dir, "conversations"))


def op13_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return found.withColumn("n_passages", F.size("passages")).drop("passages")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_quality_trees": op5_quality_trees,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_media_columns": op10_media_columns,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxic_passages": op13_toxic_passages,
}

ORACLE_SQL: dict[str, str] = ORACLES
