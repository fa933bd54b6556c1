"""Sinks: review cache with provenance, gap and evidence tables, merged tables, exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaplens.operators.tables import upsert, without

# Where reviews may come from.
PROVENANCE = ("hf", "parquet_cache", "fixture", "csv_upload")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Addresses of a table's Parquet files, by name; the table itself if it is one file."""
    target, fs = _path(spark, path)
    if fs.getFileStatus(target).isFile():
        return [path]
    found, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        if name.endswith(".parquet") and not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            found.append(name)
    return sorted(found)


def swap(df: DataFrame, path: str) -> None:
    """Replace a table by rows that may come from it: written beside it, then renamed, so a lost job leaves the old one.

    Between the two renames a reader finds no table and has to try again.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    target, fs = _path(spark, path)
    if fs.exists(target):
        fs.rename(target, _path(spark, old)[0])
    fs.rename(_path(spark, fresh)[0], target)
    fs.delete(_path(spark, old)[0], True)


def write_cache(reviews: DataFrame, path: str, package: str, provenance: str) -> None:
    """A package's reviews as Parquet, and one row beside them that says where they came from.

    The old row goes first, so new reviews never stand beside an old origin.
    """
    old, fs = _path(reviews.sparkSession, f"{path}.meta")
    fs.delete(old, True)
    swap(reviews, path)
    meta = reviews.sparkSession.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(provenance).alias("provenance"), F.lit(package).alias("package_name"), "rows")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}.meta")  # one row


def read_provenance(spark: SparkSession, path: str) -> str:
    """fixture for test folders, the sidecar's value where it is a known one, else parquet_cache."""
    if any(part in ("fixtures", "tests") for part in path.split("/")):
        return "fixture"
    if exists(spark, f"{path}.meta"):
        row = spark.read.schema("provenance string").json(f"{path}.meta").first()
        if row and row.provenance in PROVENANCE:
            return row.provenance
    return "parquet_cache"


def replace_gaps(old: DataFrame, new: DataFrame, job: str = "job_id", evidence: str = "evidence") -> DataFrame:
    """Gaps after a job's own are replaced by its new ones; gaps without evidence are not stored."""
    return without(old, new, job).unionByName(new.where(F.size(evidence) > 0))


def write_gaps(spark: SparkSession, root: str, job: str, gaps: DataFrame, evidence: DataFrame) -> int:
    """Store a job's gaps and their evidence in place of its old ones; gaps without evidence are dropped. How many were stored."""
    kept = gaps.where(F.col("job_id") == job).join(evidence.select("gap_id").distinct(), "gap_id", "left_semi")
    shown = evidence.join(kept.select("gap_id"), "gap_id", "left_semi").withColumn("job_id", F.lit(job))
    for name, rows in (("gaps", kept), ("gap_evidence", shown)):
        path = f"{root}/{name}"
        old = spark.read.parquet(path).where(F.col("job_id") != job) if exists(spark, path) else rows.limit(0)
        swap(old.unionByName(rows), path)
    return spark.read.parquet(f"{root}/gaps").where(F.col("job_id") == job).count()


def seed_catalog(spark: SparkSession, path: str, catalog: DataFrame) -> int:
    """Merge all catalog rows into the stored apps, missing numbers as 0; how many there were."""
    rows = catalog.select("package_name", "display_name", F.coalesce("review_count", F.lit(0)).alias("review_count"), "avg_stars", "github_repo", "roadmap_source")
    merge_into(spark, path, rows, "package_name")
    return rows.count()


def choose_store(probe: Callable[[], bool], remote: Callable[[], str], local: str) -> str:
    """Where tables lie: the remote root if it answers, else the local one."""
    try:
        return remote() if probe() else local
    except Exception:  # noqa: BLE001 - a store that cannot be asked is not there
        return local


def prefetch(spark: SparkSession, packages: list[str], cache: str, remote: Callable[[str], DataFrame], keep: bool = True) -> dict[str, int]:
    """Fill the review cache for some packages, keeping what is there; rows of each."""
    from gaplens.sources.tables import fetch_reviews

    return {p: fetch_reviews(spark, p, cache, remote, refresh=not keep)[0].count() for p in packages}


THEMES = ("sync", "search", "dark mode", "offline use", "widgets", "backup", "sharing")
ASKS = ("please add better {}", "I wish {} would work for me", "{} keeps failing on my phone", "there is no option to change {}", "{} is missing and I need it", "would love to see {} done right")


def synthetic_reviews(spark: SparkSession, package: str = "org.example.app") -> DataFrame:
    """Seven themes with six reviews each, for tests."""
    texts = [f"{ask.format(theme)} every single day I use this app" for theme in THEMES for ask in ASKS]
    return spark.createDataFrame([(f"r{i}", t, float(i % 3 + 1), f"2016-{i % 12 + 1:02d}-01", package, i) for i, t in enumerate(texts)], "review_id string, review_text string, rating double, created_at string, package string, ord long")


def write_contexts(contexts: DataFrame, path: str) -> None:
    """Product contexts as JSON, a folder for each package."""
    contexts.write.mode("overwrite").partitionBy("package_name").json(path)


def save_space(spark: SparkSession, path: str, terms: DataFrame, projection: list[list[float]], threshold: float) -> str:
    """A matching space as Parquet: terms (place, term, idf), its projection, threshold and a checksum over them. The checksum."""
    rows = terms.select("place", "term", "idf").orderBy("place").collect()  # a bounded vocabulary
    if not rows or len(rows) != len(projection):
        raise ValueError("one row of the projection for each term")
    checksum = _checksum([(r.place, r.term, r.idf) for r in rows], projection, threshold)
    frame = spark.createDataFrame([(r.place, r.term, r.idf, list(map(float, v)), threshold, checksum) for r, v in zip(rows, projection, strict=True)], "place int, term string, idf double, vector array<double>, threshold double, checksum string")
    swap(frame, path)
    return checksum


def load_space(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, list[list[float]], float]:
    """(terms, projection, threshold) of a saved space; ValueError outside of its root folder or with another checksum."""
    if ".." in path.split("/") or not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is not under {root}")
    frame = spark.read.parquet(path)
    rows = frame.orderBy("place").collect()  # a bounded vocabulary
    found = _checksum([(r.place, r.term, r.idf) for r in rows], [r.vector for r in rows], rows[0].threshold)
    if any(r.checksum != found for r in rows):
        raise ValueError(f"{path} was changed")
    return frame.select("place", "term", "idf"), [list(r.vector) for r in rows], rows[0].threshold


def _checksum(terms: list[tuple[int, str, float]], projection: list[list[float]], threshold: float) -> str:
    return sha256(json.dumps([terms, [list(map(float, v)) for v in projection], threshold]).encode()).hexdigest()


def write_calibration(ranks: DataFrame, stats: DataFrame, probes: DataFrame, items: DataFrame, path: str, mode: str = "char_wb", distractors: int = 12) -> None:
    """The outcome of a calibration as one JSON document: the recommended space, its figures, the items that its probes find, some that they do not, and the probes.

    A probe takes part if the space finds its item. Probes are a stated set, distractors the first few by id.
    """
    hit = ranks.where((F.col("mode") == mode) & (F.col("top1") == F.col("expected_id"))).select("probe_id", "expected_id")
    shown = items.select("item_id", F.substring("text", 1, 800).alias("text"), *(["title"] if "title" in items.columns else [F.substring("text", 1, 120).alias("title")]))
    matched = shown.join(hit.select(F.col("expected_id").alias("item_id")).distinct(), "item_id")
    others = shown.join(matched.select("item_id"), "item_id", "left_anti").orderBy("item_id").limit(distractors)
    listed = lambda df, *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    kept = matched.unionByName(others).agg(listed(matched, F.col("item_id").cast("string").alias("id"), "title", "text").alias("items"))
    asked = probes.join(hit, "probe_id", "left").drop("expected_id") if "expected_id" not in probes.columns else probes.join(hit.select("probe_id", F.lit(True).alias("found")), "probe_id", "left")
    of = lambda wanted, *columns: F.sort_array(F.array_compact(F.collect_list(F.when(wanted, F.struct(*columns)))))
    said = asked.agg(
        of(F.col("found"), F.col("probe_id").cast("string").alias("id"), "text", F.col("expected_id").cast("string").alias("expected_item_id")).alias("probes"),
        of(F.col("expected_id").isNull(), F.col("probe_id").cast("string").alias("id"), "text").alias("negative_probes"),
    )
    own = F.col("mode") == mode
    one = lambda c: F.max(F.when(own, F.col(c)))
    notes = stats.agg(
        F.max(F.when(F.col("recommended"), F.col("mode"))).alias("vectorizer_mode_recommended"),
        *[F.max(F.when(F.col("mode") == m, F.col("hits"))).alias(f"{n}_correct") for m, n in (("char_wb", "char_wb"), ("union", "union"), ("word", "word"))],
        one("threshold").alias("threshold_recommended"), one("margin").alias("margin_recommended"), one("min_true").alias("min_true_top1"), one("max_runner").alias("max_runner_up"), one("max_negative").alias("max_negative_top1"), one("overlap").alias("overlap_true_vs_negative"),
    ).crossJoin(items.agg(F.count("*").alias("n_roadmap_items")))  # one row each
    figures = F.struct("char_wb_correct", "union_correct", "word_correct", "min_true_top1", "max_runner_up", "max_negative_top1", "overlap_true_vs_negative", "n_roadmap_items")
    notes.crossJoin(kept).crossJoin(said).select("vectorizer_mode_recommended", "threshold_recommended", "margin_recommended", figures.alias("calibration_notes"), "items", "probes", "negative_probes").coalesce(1).write.mode("overwrite").json(path)  # one row each


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Upsert by a natural key; the first write makes the table."""
    swap(upsert(spark.read.parquet(path), new, key) if exists(spark, path) else new, path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV with a header, or as JSON lines."""
    out = df.write.mode("overwrite")
    out.option("header", True).option("escape", '"').csv(path) if kind == "csv" else out.json(path)
