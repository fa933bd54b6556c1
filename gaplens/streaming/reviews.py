"""Review drops as a stream: an extension, as the batch engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaplens.functions import text as tx
from gaplens.operators.reviews import min_words, rating_gate

DROP_SCHEMA = "ord long, package string, review_text string, rating string, created_at string, arrived timestamp"


def review_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Gated reviews with an id, each id once within the watermark; state is bounded by `late`."""
    rows = rating_gate(min_words(spark.readStream.schema(DROP_SCHEMA).parquet(path)))
    ids = tx.review_id(F.col("package"), F.col("rating"), F.col("created_at"), F.col("review_text"))
    return rows.withColumn("review_id", ids).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["review_id"])


def daily_needs(stream: DataFrame) -> DataFrame:
    """Reviews and needs by package and day of arrival."""
    day = F.window("arrived", "1 day")
    need = tx.need_bearing(F.col("review_text"), F.col("rating"))
    return stream.groupBy(day.alias("day"), "package").agg(F.count("*").alias("reviews"), F.count_if(need).alias("needs"))


def store(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once per checkpoint; ends when the files at hand are read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
