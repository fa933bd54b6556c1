"""Sinks keep what they should, streams equal the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from gaplens.operators.reviews import min_words, rating_gate
from gaplens.operators.records import fenced, is_junk, issue_text, product_tokens, slug
from gaplens.operators.terms import char_terms, tfidf
from gaplens.sources import sinks
from gaplens.sources.tables import read_reviews_csv
from gaplens.streaming.reviews import DROP_SCHEMA, daily_needs, review_stream, store

LONG = "I wish it had a way to sort all of the shows by hand"


def test_cache_and_provenance(spark, tmp_path):
    path = f"file://{tmp_path}/cache/a"
    assert sinks.read_provenance(spark, path) == "parquet_cache"
    rows = spark.createDataFrame([("1", LONG)], "review_id string, review_text string")
    for _ in range(2):  # the second write replaces the first
        sinks.write_cache(rows, path, "a", "hf")
    assert spark.read.parquet(path).count() == 1
    assert sinks.read_provenance(spark, path) == "hf"
    assert sinks.read_provenance(spark, "/x/fixtures/a") == "fixture"


def test_merge_reads_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/apps"
    schema = "id long, name string"
    sinks.merge_into(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], schema), "id")
    sinks.merge_into(spark, path, spark.createDataFrame([(2, None), (3, "c"), (1, "z")], schema), "id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "z"), (2, "b"), (3, "c")]


def test_replace_gaps(spark):
    schema = "job_id string, rank int, evidence array<string>"
    old = spark.createDataFrame([("a", 1, ["x"]), ("b", 1, ["y"])], schema)
    new = spark.createDataFrame([("a", 1, ["z"]), ("a", 2, [])], schema)
    assert sorted(r.evidence[0] for r in sinks.replace_gaps(old, new).collect()) == ["y", "z"]


def test_export_and_csv_aliases(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.export(spark.createDataFrame([(LONG + ', "so"', "4", "2016-01-01")], "Review string, Stars string, Date string"), path)
    rows, found, warnings = read_reviews_csv(spark, path)
    assert found == {"review_text": "Review", "rating": "Stars", "created_at": "Date"} and warnings == []
    assert [tuple(r) for r in rows.collect()] == [(LONG + ', "so"', "4", "2016-01-01")]


def test_stream_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 5, 1, 12)
    rows = [(1, "p", LONG, "2", "2024-05-01", day), (2, "p", LONG, "2", "2024-05-01", day), (3, "p", "too short", "1", None, day), (4, "q", LONG, "5", None, day), (5, "q", LONG + " now", None, None, day), (6, None, None, None, None, day)]
    drops, out = f"{tmp_path}/drops", f"{tmp_path}/out"
    frame = spark.createDataFrame(rows, DROP_SCHEMA)
    frame.write.parquet(drops)
    assert store(review_stream(spark, drops), out, f"{tmp_path}/mark").awaitTermination(120)
    got = spark.read.parquet(out)
    batch = rating_gate(min_words(frame)).dropDuplicates(["package", "rating", "created_at", "review_text"])
    assert sorted(r.review_text for r in got.collect()) == sorted(r.review_text for r in batch.collect())
    assert {r.package: (r.reviews, r.needs) for r in daily_needs(got).collect()} == {"p": (1, 1), "q": (1, 1)}


def test_record_edges(spark):
    row = spark.range(1).select(
        issue_text(F.lit(None), F.lit(None)).alias("none"), issue_text(F.lit("T"), F.lit("- [ ] a\nbody")).alias("both"), slug(F.lit("--")).alias("slug"),
        fenced(F.lit(" {} ")).alias("plain"), is_junk(F.lit(None).cast("string")).alias("junk"), char_terms(F.lit("Go")).alias("grams"),
    ).first()
    assert tuple(row) == ("", "T. T. T. body", "custom.app", "{}", True, [" go", "go ", " go "])
    assert product_tokens("My Fine-App", "org.Tail") == ["fine", "app", "tail"]


def test_tfidf_has_unit_norms_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a podcast app"), (2, "an app"), (3, None)], "id long, text string")
    norms = tfidf(docs, "id", char_terms(F.col("text"))).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.id for r in norms} == {1, 2} and all(abs(r.n - 1) < 1e-4 for r in norms)
    assert tfidf(docs.limit(0), "id", char_terms(F.col("text"))).count() == 0
