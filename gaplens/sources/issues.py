"""Issue trackers from JSON dumps: issues and milestones as roadmap items, planned lists with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.operators import records

ISSUE_DUMP = "number long, title string, body string, state string, html_url string, comments long, created_at string, updated_at string, closed_at string, labels array<struct<name:string>>, milestone struct<title:string>, pull_request string, description string, due_on string"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A tracker's answer as saved: a JSON array or lines of objects."""
    return spark.read.schema(ISSUE_DUMP).option("multiLine", True).json(path)


def _age(updated: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(updated))) / 86_400e6)


def milestone_items(milestones: DataFrame, now: Column) -> DataFrame:
    """Milestones with a title that is no version number."""
    title = F.trim(F.coalesce("title", F.lit("")))
    updated = F.coalesce("updated_at", "created_at")
    return milestones.where((title != "") & ~records.is_version_title(title)).select(
        F.concat(F.lit("milestone-"), F.col("number").cast("string")).alias("issue_id"), records.issue_text(title, records.issue_body(F.col("description"))).alias("text"), title.alias("title"), F.lit("").alias("labels"), title.alias("milestone_title"),
        F.coalesce("state", F.lit("open")).alias("state"), _age(updated, now).alias("age_days"), "closed_at", F.coalesce("html_url", F.lit("")).alias("url"), updated.alias("updated_at"), "created_at", F.lit("milestone").alias("kind"), "due_on",
    )


def issue_items(issues: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """The last touched issues that are no pull requests; bodies of 4000 characters at most. `most` is the caller's quota."""
    title = F.trim(F.coalesce("title", F.lit("")))
    updated = F.coalesce("updated_at", "created_at")
    names = F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: F.coalesce(x["name"], F.lit(""))), ", ")
    rows = issues.where(F.col("pull_request").isNull()).orderBy(F.desc_nulls_last(updated), "number").limit(most)
    return rows.select(
        F.concat(F.lit("issue-"), F.col("number").cast("string")).alias("issue_id"), records.issue_text(title, F.substring(F.coalesce("body", F.lit("")), 1, 4000)).alias("text"), title.alias("title"), names.alias("labels"), F.col("milestone.title").alias("milestone_title"),
        F.coalesce("state", F.lit("open")).alias("state"), _age(updated, now).alias("age_days"), "closed_at", F.coalesce("html_url", F.lit("")).alias("url"), updated.alias("updated_at"), "created_at", F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("due_on"),
    )


def tracker_items(issues: DataFrame, milestones: DataFrame, now: Column, most: int = 200) -> DataFrame:
    return milestone_items(milestones, now).unionByName(issue_items(issues, now, most))


def planned(issues: DataFrame, milestones: DataFrame, most: int = 80) -> DataFrame:
    """(part, id, planned, title, url, snippet): milestones, then open issues by comments, as planned items with their evidence."""
    named = milestones.where(F.coalesce("title", F.lit("")) != "")
    first = named.select(F.lit(0).alias("part"), F.concat(F.lit("gh-milestone-"), F.col("number").cast("string")).alias("id"), F.concat(F.lit("[milestone:"), F.coalesce("state", F.lit("None")), F.lit("] "), F.col("title")).alias("planned"), "title", F.coalesce("html_url", F.lit("")).alias("url"), F.substring(F.coalesce("description", F.lit("")), 1, 300).alias("snippet"))
    names = F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: F.coalesce(x["name"], F.lit(""))), ", ")
    best = issues.where("state = 'open' and pull_request is null").orderBy(F.desc("comments"), "number").limit(min(most, 100))
    return first.unionByName(best.select(F.lit(1).alias("part"), F.concat(F.lit("gh-issue-"), F.col("number").cast("string")).alias("id"), F.coalesce("title", F.lit("")).alias("planned"), "title", F.coalesce("html_url", F.lit("")).alias("url"), names.alias("snippet")))
