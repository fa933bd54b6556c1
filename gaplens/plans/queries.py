"""Registered queries of the review engine; their SQL is in gaplens.plans.oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import gaps, matching, tables
from gaplens.operators import reviews as rv
from gaplens.plans import analysis, models, registry, store, talk, web
from gaplens.plans.catalog import CATALOG_QUERIES, WINDOW_END
from gaplens.sources.tables import items, members, reviews, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def fil01_min_words(spark, d):
    return rv.min_words(reviews(spark, d)).select("ord")


@query
def fil03_rating_gate(spark, d):
    return rv.rating_gate(reviews(spark, d)).select("ord", F.when(F.isnan("rating"), -1.0).otherwise(F.col("rating")).alias("rating"))


@query
def fil05_first_wins_dedupe(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("review_text"))
    return rv.first_wins(docs, tx.normalised(F.col("review_text"))).select("ord")


@query
def fil06_ingest_quota(spark, d):
    return rv.ingest(reviews(spark, d), 200).select("ord", F.when(F.isnan("rating"), -1.0).otherwise(F.col("rating")).alias("rating"))


@query
def fil07_need_bearing(spark, d):
    return rv.with_need(rv.rating_gate(reviews(spark, d))).select("ord", "need_bearing")


@query
def agg10_need_stats(spark, d):
    return rv.need_stats(rv.rating_gate(reviews(spark, d)))


def _dated(spark, d):
    closed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    state = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", closed.alias("closed"), state.alias("state"), F.lit(WINDOW_END).cast("timestamp").alias("e"))


@query
def fil17_temporal_class(spark, d):
    return _dated(spark, d).select("o_orderkey", gaps.temporal_class(F.col("o_orderdate"), F.col("closed"), F.col("state"), F.col("e")).alias("kind"), F.round(gaps.age_days(F.lit(None).cast("timestamp"), F.col("o_orderdate"), F.col("e")), 4).alias("age_days"))


@query
def fil21_citation_subset(spark, d):
    turn, conv = F.col("turn").cast("int"), F.col("conv_id").cast("int")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array(turn, conv % 5, turn, F.lit(99)).alias("cited"), F.sequence(F.lit(0), conv % 4).alias("given"))
    return rows.select("conv_id", "turn", F.array_join(gaps.citation_subset(F.col("cited"), F.col("given")).cast("array<string>"), ",").alias("kept"))


@query
def joi01_similarity_top1(spark, d):
    return matching.top1(members(spark, d), items(spark, d)).withColumn("sim", F.round("sim", 6))


@query
def joi04_evidence_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 280).alias("snippet"))
    return docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id", "toxic"), "doc_id")


@query
def joi06_nested_read(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("qty").cast("double").alias("qty"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("qty", F.lit(0.0)).alias("qty"))


@query
def joi12_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 7 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(10_000_000)).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return tables.upsert(old, new, "c_custkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query
def joi13_anti_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.without(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query
def joi14_complaint_after_close(spark, d):
    rows = _dated(spark, d).join(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey").agg(gaps.complaint_after_close(F.col("closed"), F.col("l_shipdate"), F.col("e")).alias("complained"))


@query
def agg01_cluster_summary(spark, d):
    return matching.cluster_summary(members(spark, d))


@query
def agg05_review_window(spark, d):
    return rv.review_window(reviews(spark, d))


@query
def agg06_confidence(spark, d):
    out = gaps.confidence(matching.cluster_summary(members(spark, d)), "none")
    return out.select("cluster_id", "volume", "consistency", "severity", "spread", "confidence")


@query
def agg08_hiddenness(spark, d):
    return rv.hiddenness(reviews(spark, d), "package")


@query
def agg11_rating_histogram(spark, d):
    return rv.rating_histogram(rv.rating_gate(reviews(spark, d)))


@query
def agg12_year_zero_fill(spark, d):
    return rv.year_histogram(table(spark, d, "orders").where("year(o_orderdate) <> 1995"), F.col("o_orderdate"))


@query
def agg14_package_profile(spark, d):
    return rv.package_profile(rv.rating_gate(reviews(spark, d)).where("not isnan(rating)"))


@query
def win03_margin(spark, d):
    return matching.margins(members(spark, d), items(spark, d)).select("member_id", "item_id", "s1", "s2")


@query
def win06_last_turns(spark, d):
    talk = table(spark, d, "conversations")
    ranked = talk.withColumn("r", F.row_number().over(tables_window("conv_id", F.desc("turn")))).where("r <= 4")
    return ranked.select("conv_id", "turn", "role")


def tables_window(key, order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


@query
def set01_corpus_union(spark, d):
    left = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"), F.lit("review").alias("corpus"))
    return left.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n"), F.lit("item").alias("corpus")))


@query
def set03_override_union(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return tables.override_union(parts, parts.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey")


@query
def src10_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), tx.html_text(F.col("html")).alias("text"))


@query
def str04_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", "i", "sentence")


@query
def hsh01_review_id(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.review_id(F.col("source"), F.lit(2.0), F.lit(None), F.col("text")).alias("review_id"), tx.evidence_id("web", F.col("source")).alias("evidence_id"))


@query
def jsn01_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query
def ui01_weighted_histogram(spark, d):
    return gaps.weighted_histogram(matching.cluster_summary(members(spark, d)))


QUERIES |= CATALOG_QUERIES | registry.QUERIES
