"""Relational helpers: checked broadcasts, upsert, override union, anti-delete, priority lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast only if the counted rows stay below the bound; a shuffle join otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a non-null incoming value wins."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns])


def override_union(first: DataFrame, later: DataFrame, key: str) -> DataFrame:
    return first.join(later.select(key).distinct(), key, "left_anti").unionByName(later)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def first_hit(df: DataFrame, text: str, rules: list[tuple[str, str]], default: str):
    """The value of the first rule whose keyword the text holds."""
    hit = F.lit(default)
    for keyword, value in reversed(rules):
        hit = F.when(F.contains(F.lower(F.col(text)), F.lit(keyword)), value).otherwise(hit)
    return df.withColumn("hit", hit)


def mapped(df: DataFrame, text: str, exact: list[tuple[str, str]], rules: list[tuple[str, str]]) -> DataFrame:
    """The value of an equal key, else of the first rule whose keyword the text holds, any case; null if none."""
    hit = F.lit(None).cast("string")
    for keyword, value in reversed(rules):
        hit = F.when(F.contains(F.lower(F.col(text)), F.lit(keyword)), value).otherwise(hit)
    for key, value in reversed(exact):
        hit = F.when(F.col(text) == key, value).otherwise(hit)
    return df.withColumn("hit", hit)
