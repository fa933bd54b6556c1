"""Review ingest: gates, first-wins dedupe, need flag, profiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.functions import text as tx


def min_words(df: DataFrame, least: int = 10) -> DataFrame:
    return df.where(tx.word_count(F.col("review_text")) >= least)


def rating_gate(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Ratings of 5 and more go; null and NaN stay; text that is no number becomes 3.0."""
    value = F.expr(f"try_cast({rating} as double)")
    kept = df.withColumn(rating, value).where(F.col(rating).isNull() | F.isnan(rating) | (F.col(rating) < 5.0))
    return kept.withColumn(rating, F.coalesce(F.col(rating), F.lit(3.0)))


def first_wins(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The row of least order for each key. Keys are 128-bit hashes, so no text is shuffled to find the first."""
    hashed = F.md5(F.coalesce(key, F.lit("")))
    firsts = df.groupBy(hashed.alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(firsts.select("__first"), F.col(order) == F.col("__first"), "left_semi")


def ingest(df: DataFrame, quota: int | None = None) -> DataFrame:
    """Word gate, rating gate, dedupe, ids, and the first `quota` survivors."""
    out = first_wins(rating_gate(min_words(df)), tx.normalised(F.col("review_text")))
    out = out.withColumn("review_id", tx.review_id(F.col("package"), F.col("rating"), F.col("created_at"), F.col("review_text")))
    return out.orderBy("ord").limit(quota) if quota else out


def with_need(df: DataFrame) -> DataFrame:
    return df.withColumn("need_bearing", tx.need_bearing(F.col("review_text"), F.col("rating")))


def need_stats(df: DataFrame) -> DataFrame:
    return with_need(df).agg(F.count("*").alias("reviews_total"), F.count_if("need_bearing").alias("reviews_need_bearing"))


def hiddenness(df: DataFrame, group: str, cross_cluster: bool = False) -> DataFrame:
    """Share of a group's reviews that do not ask outright, to 4 places; a need of several clusters gains a quarter of what is left to 1."""
    out = df.groupBy(group).agg(F.count("*").alias("mentions"), F.count_if(tx.explicit_request(F.col("review_text"))).alias("explicit_requests"))
    return out.withColumn("hiddenness", hidden_share(F.col("explicit_requests"), F.col("mentions"), cross_cluster))


def hidden_share(explicit: Column, mentions: Column, cross_cluster: bool = False) -> Column:
    base = 1 - explicit / F.nullif(mentions, F.lit(0))
    base = base + (1 - base) * 0.25 if cross_cluster else base
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 4), F.lit(0.0))


def insight(hidden: Column, confidence: Column) -> Column:
    return F.round(F.coalesce(hidden, F.lit(0.0)) * (F.coalesce(confidence, F.lit(0.0)) / 100.0), 4)


def need_split(df: DataFrame, need: Column) -> DataFrame:
    """Reviews that bear a need, kept within 0 and all, and the others."""
    return df.agg(F.count("*").alias("n"), need.alias("need")).select(F.greatest(F.lit(0), F.least("need", "n")).cast("long").alias("need_bearing"), (F.col("n") - F.greatest(F.lit(0), F.least("need", "n"))).cast("long").alias("other"))


def rating_histogram(df: DataFrame) -> DataFrame:
    """Counts of ratings rounded half-even, with all five buckets."""
    counts = df.where(~F.isnan("rating")).groupBy(F.rint("rating").cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    buckets = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("bucket"))
    return buckets.join(F.broadcast(counts.where("bucket between 1 and 5")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # five rows


def year_histogram(df: DataFrame, date: Column) -> DataFrame:
    """Counts by year from the first to the last, zero where a year has none."""
    counts = df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n")).where("year is not null")
    years = counts.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def review_window(df: DataFrame, now: Column | None = None) -> DataFrame:
    """First and last date and how many are dated; without any, `now` (the current time by default) is both."""
    date = tx.parsed_date(F.col("created_at"))
    now = F.current_timestamp() if now is None else now
    day = lambda edge: F.date_format(F.coalesce(edge(date), now), "yyyy-MM-dd")
    return df.agg(day(F.min).alias("window_start"), day(F.max).alias("window_end"), F.count(date).alias("dated"))


def package_profile(df: DataFrame) -> DataFrame:
    sample = F.min_by(F.when(F.trim("review_text") != "", F.substring("review_text", 1, 120)), F.when(F.trim("review_text") != "", F.col("ord")))
    return df.groupBy("package").agg(F.count("*").alias("reviews"), F.round(F.avg(F.coalesce("rating", F.lit(0.0))), 6).alias("avg_stars"), sample.alias("sample"))


def catalog_search(df: DataFrame, names: list[str], needle: str, order: list[Column], limit: int) -> DataFrame:
    """Rows with the needle in one of the columns, any case, no wildcards; an empty needle finds all. At most 100, at least 1."""
    wanted = F.lit(False)
    for name in names:
        wanted = wanted | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(needle.strip().lower())), F.lit(False))
    return df.where(wanted | F.lit(not needle.strip())).orderBy(*order).limit(max(1, min(100, limit)))


def paste_items(df: DataFrame, least: int = 8) -> DataFrame:
    """Paragraphs of a pasted text with an empty line, else its lines, as items; ids keep the index before the length gate."""
    blob = F.regexp_replace("review_text", r"^\s+|\s+$", "")
    chunks = F.when(blob.contains("\n\n"), F.split(blob, r"\n\s*\n")).otherwise(F.split(blob, "\n"))
    filled = F.filter(F.transform(chunks, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    lines = df.select("ord", F.posexplode(filled).alias("i", "text"))
    return lines.select("ord", F.concat(F.lit("paste-"), F.col("i").cast("string")).alias("item_id"), F.substring("text", 1, 1000).alias("text")).where(F.length("text") >= least)
