"""Issues, catalog rows, jobs and documents: titles, mentions, lookups and projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of version titles, of issue template lines in the order they go, and of shipped work.
VERSION_TITLE = r"(?i)^v?\d+(?:\.\d+)+(?:[-._]?[a-z0-9]+)?$"
TEMPLATE_PARTS = (
    r"(?s)<!--.*?-->",
    r"(?im)^###\s*(Checklist|Environment|App version|Device model|Android version|AntennaPod version|How to reproduce|Steps to reproduce)\b.*$",
    r"(?im)^\s*[-*]?\s*\[[ xX]?\]?\s*I have used the search function.*$",
    r"(?im)^\s*[-*]?\s*\[[ xX]?\]?\s*I have read (the )?(relevant )?(documentation|wiki).*$",
    r"(?m)^\s*[-*]\s*\[[ xX]\]\s*.*$",
    r"(?im)^\s*(Android version|AntennaPod version|App version|Device model|Device|OS version|Free space)\s*:.*$",
)
SHIPPED = r"(?iU)\b(changelog|released?|shipped)\b"
CLOSE_DATE = "2020-01-01"


def is_version_title(title: Column) -> Column:
    return F.trim(F.coalesce(title, F.lit(""))).rlike(VERSION_TITLE)


def product_tokens(name: str, package: str = "") -> list[str]:
    """Words of a product's name of 3 letters or more, then the last part of its package unless it is one of them."""
    words = [w for w in re.split(r"\W+", name.lower()) if len(w) >= 3]
    tail = package.lower().rpartition(".")[2]
    return [*words, tail] if len(tail) >= 3 and tail not in words else words


def mentions_product(blob: Column, name: str, package: str = "", strict: bool = False) -> Column:
    """The name, the package, the first three tokens together, or the only token. Strict: a single token is not enough, the package gives none."""
    text = F.lower(F.coalesce(blob, F.lit("")))
    found = F.lit(False)
    for whole in (name, package):
        if whole:
            found = found | text.contains(whole.lower())
    tokens = product_tokens(name, "" if strict else package)
    if len(tokens) >= (2 if strict else 1):
        every = F.lit(True)
        for t in tokens[:3]:
            every = every & text.contains(t)
        found = found | every
    return found


def is_junk(text: Column, least: int = 40, hyphens: int = 12) -> Column:
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) < least) | (F.length(body) - F.length(F.replace(body, F.lit("-"), F.lit(""))) > hyphens)


def is_issue(raw: Column) -> Column:
    """Whether a tracker's JSON row is an issue: one with the key pull_request is none, whatever its value."""
    return ~F.array_contains(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), "pull_request")


def issue_body(body: Column) -> Column:
    """An issue's text without template lines; (?d) keeps \\n the only line end."""
    out = F.coalesce(body, F.lit(""))
    for part in TEMPLATE_PARTS:
        out = F.regexp_replace(out, f"(?d){part}", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))


def issue_text(title: Column, body: Column, weight: int = 3) -> Column:
    """The title several times, then the body; either alone where the other is empty."""
    head, rest = F.trim(F.coalesce(title, F.lit(""))), issue_body(body)
    return F.array_join(F.concat(F.when(head != "", F.array_repeat(head, weight)).otherwise(F.array().cast("array<string>")), F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))), ". ")


def slug(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "."), r"^\.|\.$", "")
    return F.concat(F.lit("custom."), F.when(plain == "", "app").otherwise(plain))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order for each key, by a partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def with_evidence(gaps: DataFrame, evidence: DataFrame, gap: Column, owner: Column, order: list[Column], top: int = 5) -> DataFrame:
    """Gaps that have evidence, ranked anew from 1; a top-k report."""
    best = gaps.join(evidence, gap == owner, "left_semi").orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fenced(text: Column) -> Column:
    """What stands in a markdown code fence; a text without one as it is."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner == "", F.trim(text)).otherwise(inner)


def flat_list(items: Column, most: int = 12, width: int = 2000) -> Column:
    return F.substring(F.array_join(F.slice(items, 1, most), " | "), 1, width)


def split_urls(text: Column) -> Column:
    """Addresses with http or https between spaces and commas, each once, in order."""
    return F.array_distinct(F.filter(F.split(text, r"[\s,]+"), lambda u: u.rlike("^https?://")))


def page_items(pages: DataFrame, title: Column, text: Column) -> DataFrame:
    """Pages with a text as roadmap items; those that speak of shipped work are closed at a constant date."""
    done = F.concat(F.coalesce(title, F.lit("")), text).rlike(SHIPPED)
    rows = pages.where(F.coalesce(text, F.lit("")) != "")
    rows = rows.withColumn("item_id", F.concat(F.lit("web-"), F.col("page_id").cast("string"))).withColumn("item_text", F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), text), 1, 1000))
    return rows.withColumn("state", F.when(done, "closed").otherwise("open")).withColumn("closed_at", F.when(done, F.lit(CLOSE_DATE).cast("timestamp")))


def representative(df: DataFrame, key: str, text: Column, need: Column, central: Column | None = None) -> DataFrame:
    """(key, ord, quote): the review to quote for each group.

    The member whose text is the central one, or begins with its first 80 characters, if it bears a need (the first such member
    decides); else the first with a need, else the first with a text, else no member and a placeholder.
    """
    said = F.trim(F.coalesce(text, F.lit("")))
    rows = df.withColumn("__text", said).withColumn("__need", need & (said != ""))
    like = F.lit(False) if central is None else (F.trim(central) != "") & ((said == F.trim(central)) | said.startswith(F.substring(F.trim(central), 1, 80)))
    row = F.struct("ord", "__text", "__need")
    first = lambda wanted: F.min_by(F.when(wanted, row), F.when(wanted, F.col("ord")))
    found = rows.groupBy(key).agg(first(like).alias("c"), first(F.col("__need")).alias("n"), first(said != "").alias("t"))
    chosen = F.when(F.col("c.__need"), F.col("c")).otherwise(F.coalesce("n", "t"))
    return found.select(key, chosen["ord"].alias("ord"), F.coalesce(chosen["__text"], F.lit("(no review text)")).alias("quote"))


def first_by(df: DataFrame, key: str, orders: dict[str, list[Column]], top: int) -> DataFrame:
    """Rows among the first of their group in any of several orders, with their place in each."""
    ranked = df.select("*", *[F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias(name) for name, order in orders.items()])
    near = F.lit(False)
    for name in orders:
        near = near | (F.col(name) <= top)
    return ranked.where(near)
