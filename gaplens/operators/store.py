"""Apps, jobs and the catalog as tables: defaults, projections, nested reads, lookups and merges."""

from __future__ import annotations

import json
from hashlib import sha256
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.functions import text as tx

# What an app or a job has where nothing is stored.
DATASET = "sealuzh/app_reviews"
JOB_FIELDS = ("status", "stage", "progress", "error", "summary", "stats", "roadmap_snapshot", "completed_at", "config_hash")
JOB_STATES = ("queued", "running", "completed", "failed")
METRIC_KEYS = ("components", "weights", "deterministic_confidence", "cluster_size", "total_reviews", "best_similarity", "mean_rating", "rating_spread", "cohesion")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalised_app(apps: DataFrame) -> DataFrame:
    """Apps with their types and defaults; the item count may lie in the metadata, a JSON text."""
    in_meta = F.get_json_object("metadata", "$.roadmap_item_count").cast("int")
    return apps.select(
        "id", "package_name", "display_name",
        F.coalesce(F.col("review_count").cast("int"), F.lit(0)).alias("review_count"),
        F.col("avg_stars").cast("double").alias("avg_stars"),
        "github_repo",
        F.coalesce(F.nullif(F.col("roadmap_source"), F.lit("")), F.lit("none")).alias("roadmap_source"),
        F.coalesce(F.col("roadmap_item_count").cast("int"), in_meta, F.lit(0)).alias("roadmap_item_count"),
        "sample_review",
        F.coalesce(F.nullif(F.col("dataset"), F.lit("")), F.lit(DATASET)).alias("dataset"),
    )


def public_app(apps: DataFrame) -> DataFrame:
    """The nine fields that are shown of an app."""
    return normalised_app(apps).drop("dataset")


def job_view(jobs: DataFrame) -> DataFrame:
    """What is shown of a job; its statistics, a JSON text, with their defaults."""
    stat = lambda name, kind, default: F.coalesce(F.get_json_object("stats", f"$.{name}").cast(kind), F.lit(default)).alias(name)
    total = F.coalesce(F.get_json_object("stats", "$.reviews_total").cast("int"), F.get_json_object("stats", "$.total_reviews").cast("int"), F.lit(0))
    return jobs.select(
        "id", "status", F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.lit("queued")).alias("stage"), F.coalesce(F.col("progress").cast("int"), F.lit(0)).alias("progress"),
        F.coalesce(F.nullif(F.col("roadmap_source"), F.lit("")), F.lit("none")).alias("roadmap_source"),
        stat("total_reviews", "int", 0), stat("clusters", "int", 0), stat("roadmap_items", "int", 0), stat("llm_used", "boolean", False),
        stat("embedding_backend", "string", ""), stat("elapsed_s", "double", 0.0), stat("review_provenance", "string", "parquet_cache"),
        total.alias("reviews_total"), stat("reviews_need_bearing", "int", 0),
    )


def allowed_update(fields: dict[str, Any], allowed: tuple[str, ...] = JOB_FIELDS) -> dict[str, Any]:
    """The fields of an update that may be changed."""
    return {k: v for k, v in fields.items() if k in allowed}


def create_job(jobs: DataFrame, job: dict[str, Any]) -> DataFrame:
    """Jobs and one more, queued, with empty statistics where none are given."""
    row = {"status": "queued", "stage": "queued", "progress": 0, "stats": json.dumps({"total_reviews": 0, "clusters": 0, "roadmap_items": 0, "llm_used": False, "embedding_backend": "", "elapsed_s": 0.0, "degraded": []})} | job
    return jobs.unionByName(jobs.sparkSession.createDataFrame([tuple(row.get(c) for c in jobs.columns)], jobs.schema))


def update_job(jobs: DataFrame, job_id: str, fields: dict[str, Any]) -> DataFrame:
    """Jobs with allowed fields of one changed; KeyError if it does not exist."""
    if not jobs.where(F.col("id") == job_id).limit(1).count():
        raise KeyError(job_id)
    types = dict(jobs.dtypes)
    changed = {k: F.when(F.col("id") == job_id, F.lit(v).cast(types[k])).otherwise(F.col(k)) for k, v in allowed_update(fields).items() if k in types}
    return jobs.withColumns(changed) if changed else jobs


def point_lookup(rows: DataFrame, key: str, value: object, order: str) -> DataFrame:
    """The first row of a key, or none."""
    return rows.where(F.col(key) == value).orderBy(order).limit(1)


def nested_jobs(jobs: DataFrame, apps: DataFrame, gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Jobs with their app, if it exists, and their gaps by rank, each with its evidence."""
    shown = evidence.groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "source_type"))).alias("evidence"))  # a gap's evidence
    full = gaps.join(shown, "gap_id", "left").select("job_id", F.struct("rank", "gap_id", "verdict", F.coalesce("evidence", F.array().cast("array<struct<evidence_id:string,source_type:string>>")).alias("evidence")).alias("gap"))
    listed = full.groupBy("job_id").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))  # a job's gaps
    return jobs.join(apps, "app_id", "left").join(listed, "job_id", "left")


def known_repos(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Packages with their own repository, else a known one."""
    return rows.join(known.select("package_name", F.col("github_repo").alias("__known")), "package_name", "left").withColumn("github_repo", F.coalesce(_blank(F.col("github_repo")), "__known")).drop("__known")


def catalog(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The searchable catalog: no blank repository, a source and a name for every app."""
    out = rows.join(names.select("package_name", F.col("name").alias("__name")), "package_name", "left").withColumn("github_repo", _blank(F.col("github_repo")))
    out = out.withColumn("roadmap_source", F.coalesce(F.nullif(F.col("roadmap_source"), F.lit("")), F.when(F.col("github_repo").isNotNull(), "github").otherwise("none")))
    return out.withColumn("display_name", F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.nullif(F.col("app_name"), F.lit("")), "__name", tx.display_name(F.col("package_name")))).drop("__name")


def rebuilt_catalog(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """Catalog rows from an inventory of texts: typed, named, with known repositories."""
    rows = known_repos(inventory, known)
    name = F.coalesce(_blank(F.col("app_name")), tx.spaced_name(F.col("package_name")))
    out = rows.select(
        "package_name", name.alias("display_name"), F.coalesce(F.expr("try_cast(reviews as int)"), F.lit(0)).alias("reviews"), F.expr("try_cast(avg_stars as double)").alias("avg_stars"),
        F.coalesce(F.nullif(F.col("dataset"), F.lit("")), F.lit(DATASET)).alias("dataset"), "github_repo", F.when(F.col("github_repo").isNotNull(), "github").otherwise("none").alias("roadmap_source"), F.col("github_repo").isNotNull().alias("likely_applicable"),
    )
    return out


def listed(apps: DataFrame, least: int = 50, top: int = 50, only_repo: bool = False, only_roadmap: bool = False) -> DataFrame:
    """The apps with most reviews, enough of them, and if asked a repository or any roadmap; a top-k report."""
    rows = apps.where(F.col("reviews") >= least)
    rows = rows.where("github_repo is not null") if only_repo else rows
    rows = rows.where("github_repo is not null or roadmap_source <> 'none'") if only_roadmap else rows
    return rows.orderBy(F.desc("reviews"), "package_name").limit(top)


def console_line(place: Column, reviews: Column, stars: Column, repo: Column, name: Column) -> Column:
    """One line of a listing in columns of fixed width."""
    return F.concat(F.lpad(place.cast("string"), 3, " "), F.lit("  "), F.lpad(reviews.cast("string"), 8, " "), F.lit("  "), F.lpad(stars.cast("string"), 5, " "), F.lit("  "), F.rpad(F.coalesce(repo, F.lit("-")), 42, " "), F.lit("  "), F.substring(name, 1, 46))


def context_summary(contexts: DataFrame) -> DataFrame:
    """Identity and list sizes of product contexts."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(f"{c}_n")
    return contexts.select("product_id", "display_name", "roadmap_source", *[size(c) for c in ("current_features", "planned_items", "promised_unshipped", "evidence")], F.trim("notes").alias("notes"))


def catalog_fallback(wanted: DataFrame, apps: DataFrame, rows: DataFrame) -> DataFrame:
    """Review counts and stars of packages: of the stored app if there is one, else of the catalog, else none."""
    first = rows.groupBy("package_name").agg(F.min_by(F.struct("reviews", "avg_stars"), F.col("pos")).alias("c"))
    joined = wanted.join(apps.select("package_name", F.col("review_count").alias("a_n"), F.col("avg_stars").alias("a_s"), F.lit(True).alias("known")), "package_name", "left").join(first, "package_name", "left")
    known = F.coalesce("known", F.lit(False))
    return joined.select("package_name", F.when(known, F.col("a_n")).otherwise(F.coalesce("c.reviews", F.lit(0))).alias("review_count"), F.when(known, F.col("a_s")).otherwise(F.col("c.avg_stars")).alias("avg_stars"))


def config_hash(settings: dict[str, Any]) -> str:
    """24 hex digits of a configuration, whatever the order of its keys."""
    return sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:24]


def config_digest(settings: Column, names: list[str]) -> Column:
    """24 hex digits of a struct of settings, whatever the order of its fields: they are written by name."""
    return F.substring(F.sha2(F.to_json(F.struct(*[settings[n].alias(n) for n in sorted(names)])), 256), 1, 24)


def merged_metadata(old: Column, new: Column) -> Column:
    """Two maps as one; the incoming value wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def metric_subset(metrics: Column, keys: tuple[str, ...] = METRIC_KEYS) -> Column:
    return F.map_filter(metrics, lambda k, _: k.isin(*keys))


def valid_apps(apps: DataFrame) -> DataFrame:
    """Rows that keep the table's rules: an id, a package that no lesser id has, no negative count."""
    rows = apps.where("id is not null and package_name is not null and coalesce(review_count, 0) >= 0")
    return rows.join(rows.groupBy("package_name").agg(F.min("id").alias("id")), ["package_name", "id"], "left_semi")


def valid_gaps(gaps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Gaps of existing jobs with a known verdict, a rank from 1 and a confidence from 0 to 100."""
    known = F.col("verdict").isin("IGNORED", "MISUNDERSTOOD", "UNDER-PRIORITIZED", "UNVERIFIED")
    return gaps.where(known & F.col("rank").between(1, 5) & F.col("confidence").between(0, 100)).join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
