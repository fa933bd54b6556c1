"""Whole jobs from the other operators: reuse by configuration, charts, custom apps, discovery listings, a description of the engine."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import analysis, chat, embedding, extraction, records, store, tables, terms
from gaplens.operators import reviews as rv
from gaplens.sources import sinks
from gaplens.sources.shared import settled
from gaplens.sources.tables import check_upload, ingest_csv


def reusable_job(jobs: DataFrame, app_id: object, settings: dict[str, Any], force: bool = False) -> DataFrame:
    """The last completed job of an app with the same configuration; none if a new one is forced."""
    rows = jobs.where((F.col("app_id") == app_id) & (F.col("status") == "completed") & (F.col("config_hash") == store.config_hash(settings)))
    return rows.orderBy(F.desc("completed_at"), "id").limit(0 if force else 1)


def found_gaps(reviews: DataFrame, roadmap: DataFrame, cache: str, model: Callable[[str], str] | None = None, top: int = 5, pool: int = 8) -> DataFrame:
    """The ranked gaps of one package's reviews (ord, review_text, rating), from texts to cited needs; a top-k report.

    Need-bearing reviews are clustered in one space with the roadmap's texts (item_id, text). Matching is off, as by default:
    every verdict is UNVERIFIED. The best clusters go to the model, or are quoted where there is none, and are ranked anew.
    """
    gated = rv.rating_gate(reviews).where(tx.need_bearing(F.col("review_text"), F.col("rating")))
    need = settled(gated.select(F.col("ord").alias("member_id"), "ord", "review_text", "rating"))
    _, found, _ = embedding.embed_and_cluster(need, roadmap)
    members = settled(found.join(need.select("member_id", "rating"), "member_id"))
    best = settled(analysis.extracted(analysis.analyse_alone(members, need), pool, max(pool, top)).drop("rank"))
    said = need.join(members.select("member_id", "cluster_id"), "member_id")
    central = best.select("cluster_id", F.col("central_id").alias("member_id")).join(need.select("member_id", F.col("review_text").alias("central")), "member_id").drop("member_id")
    quotes = records.representative(said.join(central, "cluster_id"), "cluster_id", F.col("review_text"), F.lit(True), F.col("central"))
    words = terms.keywords(said, "cluster_id", "member_id", "review_text").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("keywords"))  # eight a cluster
    cited = analysis.first_members(members, "cluster_id", "member_id", 12).select("cluster_id", F.transform("ids", lambda x: x.cast("string")).alias("provided"))
    rows = best.join(quotes, "cluster_id").join(cited, "cluster_id").join(words, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    prompt = chat.extraction_prompt(F.array_join("provided", ","), F.lit(None).cast("string"), F.lit("UNVERIFIED"), "none", F.col("keywords"))
    candidates = rows.select("cluster_id", F.when(F.lit(model is not None), prompt).alias("prompt"), "provided", F.lit("UNVERIFIED").alias("verdict"), F.col("confidence").alias("deterministic"), "quote", F.col("ord").cast("string").alias("quote_id"))
    made = extraction.extract(candidates, model or str, cache)
    kept = best.join(words, "cluster_id", "left").select("cluster_id", "size", "cohesion", "mean_rating", "hiddenness", "mentions", "explicit_requests", "keywords")
    final = made.join(kept, "cluster_id").withColumn("insight", rv.insight(F.col("hiddenness"), F.col("confidence")))
    return analysis.rank_gaps(final).where(F.col("rank") <= top)


def run(spark: SparkSession, job: str, reviews: DataFrame, roadmap: DataFrame, root: str, model: Callable[[str], str] | None = None, top: int = 5) -> int:
    """One job from reviews to stored gaps and evidence under `root`, in place of its old ones; how many gaps it stored."""
    gaps = settled(found_gaps(reviews, roadmap, f"{root}/model", model, top).withColumn("job_id", F.lit(job)).withColumn("gap_id", F.concat(F.lit(f"{job}-"), F.col("rank").cast("string"))))
    cited = gaps.select(F.col("gap_id").alias("cluster_id"), F.transform("cited", lambda x: x.cast("long")).alias("ids"))
    evidence = analysis.review_evidence(cited, reviews.select(F.col("ord").cast("long").alias("review_id"), "review_text"))
    return sinks.write_gaps(spark, root, job, gaps, evidence.withColumnRenamed("cluster_id", "gap_id").drop("pos"))


def charts(reviews: DataFrame, need_bearing: int | None, stored: dict[str, Any] | None = None) -> dict[str, Any]:
    """Yearly counts, ratings and the need split; stored charts are used again if they are yearly, else rebuilt."""
    if stored and stored.get("period") == "year" and stored.get("reviews_by_period"):
        return stored
    rated = reviews.where(F.col("rating").isNotNull())
    years = rv.year_histogram(reviews, tx.parsed_date(F.col("created_at"))).orderBy("year").collect()  # one row a year
    stars = rv.rating_histogram(rated).orderBy("bucket").collect()  # five rows
    split = rv.need_split(reviews, F.max(F.lit(need_bearing or 0))).first()
    return {
        "period": "year",
        "reviews_by_period": [{"period": f"{r.year:04d}", "count": r.n} for r in years],
        "rating_histogram": [{"stars": r.bucket, "count": r.n} for r in stars] if reviews.limit(1).count() else [],
        "need_bearing": {"need_bearing": split.need_bearing or 0, "other": split.other or 0},
    }


def custom_app(spark: SparkSession, name: str, path: str, size: int, cache: str, limit: int, roadmap: str = "", settings: dict[str, Any] | None = None) -> dict[str, Any]:
    """An app of a user's own CSV and roadmap: its package, the kept reviews, the roadmap's items and the job to queue.

    The package is the slug of the name with eight digits of a hash of name and file, so two apps of one name differ.
    """
    check_upload(path, size)
    package = spark.range(1).select(records.slug(F.lit(name)).alias("s")).first().s + "." + sha256(f"{name}\0{path}".encode()).hexdigest()[:8]
    kept, report = ingest_csv(spark, package, path, cache, limit)
    items = rv.paste_items(spark.createDataFrame([(0, roadmap)], "ord long, review_text string"))
    source = "web" if items.limit(1).count() else "none"
    job = {"id": sha256(package.encode()).hexdigest()[:16], "app_id": package, "status": "queued", "stage": "queued", "progress": 0, "config_hash": store.config_hash(settings or {}), "roadmap_source": source}
    return {"package_name": package, "reviews": kept, "report": report, "items": items, "job": job}


def discovery(reviews: DataFrame, exact: list[tuple[str, str]], rules: list[tuple[str, str]], least: int = 50, top: int = 50, only_repo: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inventory of all packages with their likely repository, the listed ones)."""
    profile = rv.package_profile(reviews).withColumnRenamed("package", "package_name").withColumnRenamed("avg_stars", "stars")
    found = tables.mapped(profile, "package_name", exact, rules).withColumnRenamed("hit", "github_repo")
    inventory = found.select("package_name", "reviews", F.round("stars", 2).alias("avg_stars"), F.col("sample").alias("sample_review"), F.lit(store.DATASET).alias("dataset"), "github_repo", F.col("github_repo").isNotNull().alias("likely_applicable"), F.when(F.col("github_repo").isNotNull(), "github").otherwise("none").alias("roadmap_source"))
    return inventory, store.listed(inventory, least, top, only_repo)


def write_discovery(inventory: DataFrame, candidates: DataFrame, root: str) -> None:
    """The inventory as CSV, the candidates as CSV and JSON."""
    sinks.export(inventory, f"{root}/all_packages")
    sinks.export(candidates, f"{root}/candidates_csv")
    sinks.export(candidates, f"{root}/candidates", "json")


def describe(spark: SparkSession, cache: str, backend: str = "tfidf", model: str | None = None) -> dict[str, Any]:
    """What this engine can do as it is set up."""
    return {"ok": True, "spark": spark.version, "cache": sinks.exists(spark, cache), "embedding_backend": backend, "llm_enabled": model is not None}
