"""Temporal classes, verdicts, confidence and ranked gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.functions.text import CLOSED_STATES

# Weights of volume, novelty, consistency, severity and spread.
WEIGHTS = {"roadmap": (0.30, 0.25, 0.20, 0.15, 0.10), "none": (0.35, 0.00, 0.30, 0.20, 0.15)}


def temporal_class(created: Column, closed: Column, state: Column, end: Column) -> Column:
    done = (closed <= end) | (F.lower(state).isin(*CLOSED_STATES) & closed.isNull())
    return F.when(created > end, "future").when(done, "closed").otherwise("open")


def age_days(updated: Column, created: Column, end: Column) -> Column:
    """Days from the last touch to the window's end, never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(F.coalesce(updated, created))) / 86_400e6)


def complaint_after_close(closed: Column, member: Column, end: Column) -> Column:
    """Aggregate over a cluster's members: is any of them undated or after the close?"""
    after = member.isNull() | ((member >= closed) & (member <= end)) | (member > closed)
    return F.when(F.max(closed).isNull(), True).when(F.max(closed) > F.max(end), False).otherwise(F.coalesce(F.bool_or(after), F.lit(False)))


def verdict(accepted: Column, kind: Column, complained: Column, age: Column, has_milestone: Column) -> Column:
    """Null where the cluster is no gap."""
    return (
        F.when(~accepted | (kind == "future"), "IGNORED")
        .when((kind == "closed") & complained, "MISUNDERSTOOD")
        .when((kind == "open") & ((age > 365) | ~has_milestone), "UNDER-PRIORITIZED")
    )


def confidence(clusters: DataFrame, mode: str, similarity: Column | None = None) -> DataFrame:
    """clusters with the five components and their weighted sum times 100, to 2 places."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    largest = clusters.agg(F.greatest(F.max("size"), F.lit(1)).alias("__max"))
    volume = F.log1p(F.col("size").cast("double")) / F.log1p(F.col("__max").cast("double"))
    parts = {
        "volume": volume,
        "novelty": F.lit(1.0) if similarity is None else F.coalesce(1 - similarity, F.lit(1.0)),
        "consistency": clip(F.col("cohesion")),
        "severity": clip((5 - F.col("mean_rating")) / 4),
        "spread": clip(F.col("rating_spread")),
    }
    out = clusters.crossJoin(F.broadcast(largest)).select(*clusters.columns, *[F.round(v, 6).alias(k) for k, v in parts.items()])  # one row
    total = sum((w * F.col(k) for w, k in zip(WEIGHTS[mode], parts, strict=True)), F.lit(0.0))
    return out.withColumn("confidence", F.round(100 * total, 2))


def ranked(gaps: DataFrame, top: int = 5) -> DataFrame:
    """The first gaps by insight, confidence and cluster id, numbered from 1; a top-k report."""
    best = gaps.orderBy(F.desc("insight"), F.desc("confidence"), "cluster_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("insight"), F.desc("confidence"), "cluster_id")))


def citation_subset(cited: Column, provided: Column) -> Column:
    """Cited ids that were provided, in cited order."""
    return F.filter(cited, lambda x: F.array_contains(provided, x))


def weighted_histogram(clusters: DataFrame) -> DataFrame:
    """Reviews by mean rating rounded half up, and their share in percent."""
    sums = clusters.groupBy(F.floor(F.col("mean_rating") + 0.5).cast("int").alias("stars")).agg(F.sum("size").alias("n"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("__all")))).select("stars", "n", F.round(100 * F.col("n") / F.col("__all"), 4).alias("percent"))  # one row
