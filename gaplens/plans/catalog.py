"""Queries over issues, catalog rows, jobs and terms; their SQL is in gaplens.plans.oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import gaps, matching, records, store, terms
from gaplens.operators import reviews as rv
from gaplens.sources.tables import items, members, reviews, table

CATALOG_QUERIES = {}
WINDOW_END = "2017-06-30 00:00:00"


def query(fn):
    CATALOG_QUERIES[fn.__name__] = fn
    return fn


def _versions(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, "-rc1").when(F.col("p_partkey") % 3 == 1, " beta").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), tail).alias("title"))


@query
def fil09_version_title(spark, d):
    return _versions(spark, d).select("p_partkey", records.is_version_title(F.col("title")).alias("is_version"))


@query
def fil15_junk_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", records.is_junk(F.col("text")).alias("junk"))


@query
def fil20_evidence_required(spark, d):
    found = records.with_evidence(table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey"), F.col("o_custkey"), [F.desc("c_acctbal"), F.asc("c_custkey")])
    return found.select("rank", "c_custkey")


@query
def fil24_completed_job(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return records.latest(done, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query
def joi18_want_rate(spark, d):
    want = F.col("review_text").rlike(rf"(?iU)\b({tx.WANT})\b")
    return reviews(spark, d).groupBy("package").agg(F.count("*").alias("n"), F.count_if(want).alias("wants"), F.round(F.count_if(want) / F.count("*"), 6).alias("rate"))


@query
def agg19_degraded_set(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("notes"))  # a source each


@query
def agg21_upload_summary(spark, d):
    rows = rv.rating_gate(reviews(spark, d)).where("not isnan(rating)")
    return rows.groupBy("package").agg(F.round(F.avg("rating"), 2).alias("stars"), F.min_by(F.substring("review_text", 1, 280), F.col("ord")).alias("sample"))


@query
def agg22_open_and_total(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))


@query
def agg23_document_frequency(spark, d):
    return terms.document_frequency(table(spark, d, "documents"), terms.words(F.col("text")))


@query
def ml01_char_tfidf(spark, d):
    return terms.tfidf(table(spark, d, "benchmark"), "item_id", terms.char_terms(F.col("text")))


@query
def win09_top_three(spark, d):
    return matching.nearest(members(spark, d), items(spark, d), 3).select("member_id", "item_id", "place")


@query
def str06_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", records.slug(F.concat(F.lit("("), F.col("p_name"), F.lit(")"))).alias("slug"))


@query
def str14_fence(spark, d):
    return table(spark, d, "events").select("event_id", records.fenced(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).alias("props"))


@query
def prj04_flat_row(spark, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, d, "documents").select("doc_id", records.flat_list(lines).alias("flat"), F.size(lines).alias("n"))


@query
def jsn02_bounds(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int").between(0, 100) & (F.length("props") <= 500)).select("event_id")


@query
def hsh03_config_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", store.config_digest(F.struct("c_name", "c_custkey", "c_mktsegment"), ["c_name", "c_custkey", "c_mktsegment"]).alias("hash"))


@query
def src15_split_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(records.split_urls(F.concat("url", F.lit(", ftp://x.org "), F.col("url"), F.lit(" http://a.org"))), " ").alias("urls"))


@query
def ui03_contributions(spark, d):
    found = gaps.confidence(matching.cluster_summary(members(spark, d)), "none")
    parts = [F.struct(F.lit(k).alias("part"), F.round(100 * w * F.col(k), 2).alias("points")) for k, w in zip(("volume", "consistency", "severity", "spread"), (0.35, 0.30, 0.20, 0.15), strict=True)]
    return found.select("cluster_id", F.explode(F.array(*parts)).alias("p")).select("cluster_id", "p.*")
