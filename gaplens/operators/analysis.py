"""Gap analysis of clusters against a roadmap: matches, verdicts, later items, confidence, evidence and ranked gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.functions.text import CLOSED_STATES
from gaplens.operators import gaps, matching
from gaplens.operators import reviews as rv

# Least similarity of a match and least margin, by embedding backend.
THRESHOLDS = {"tfidf": (0.16, 0.0), "minilm": (0.45, 0.05)}
#: Kinds of evidence in the order they are shown.
EVIDENCE_ORDER = ("review", "github_issue", "web_page")


def active_threshold(backend: str | None) -> tuple[float, float]:
    """Threshold and margin of a backend; any unknown one is lexical."""
    return THRESHOLDS.get((backend or "tfidf").lower().strip(), THRESHOLDS["tfidf"])


def accepts(score: Column, threshold: float) -> Column:
    """A score that reaches the threshold; no match is no acceptance."""
    return F.coalesce(score >= threshold, F.lit(False))


def split_items(items: DataFrame, end: Column) -> tuple[DataFrame, DataFrame]:
    """(items of the review window's time, items created after it)."""
    future = F.coalesce(F.col("created_at") > end, F.lit(False))
    return items.where(~future), items.where(future)


def post_close_items(items: DataFrame, end: Column) -> DataFrame:
    """Items of the window's time that were closed after it, or touched after it and are closed-like."""
    closed_like = F.lower(F.coalesce("state", F.lit(""))).isin(*CLOSED_STATES)
    late = F.coalesce(F.col("closed_at") > end, F.lit(False)) | F.coalesce((F.col("updated_at") > end) & closed_like, F.lit(False))
    return split_items(items, end)[0].where(late)


def cluster_match(members: DataFrame, items: DataFrame, space: DataFrame | None = None) -> DataFrame:
    """The vote of each cluster with enough agreement; with a matching space the members' vectors come from it, else their own."""
    if space is not None:
        members = members.drop("embedding").join(space.select("member_id", "embedding"), "member_id")
    return matching.plurality(matching.top1(members, items)).where("accepted")


def later_payload(items: DataFrame) -> DataFrame:
    """What is shown of a later item: the day it was closed, created or touched, and 200 characters of its title."""
    date = F.coalesce("closed_at", "created_at", "updated_at")
    return items.select("item_id", F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("title"), "url", "state", F.date_format(date, "yyyy-MM-dd").alias("date"))


def later_addressed(members: DataFrame, items: DataFrame, end: Column, threshold: float) -> DataFrame:
    """(cluster_id, later_id, later_score): an item created after the window, else one closed after it, that the cluster matches."""
    future = cluster_match(members, split_items(items, end)[1]).where(accepts(F.col("score"), threshold))
    closed = cluster_match(members, post_close_items(items, end)).where(accepts(F.col("score"), threshold))
    pick = lambda df, name: df.select("cluster_id", F.struct("item_id", "score").alias(name))
    both = pick(future, "f").join(pick(closed, "c"), "cluster_id", "full_outer")
    hit = F.coalesce("f", "c")
    return both.select("cluster_id", hit["item_id"].alias("later_id"), hit["score"].alias("later_score"))


def complained_after(members: DataFrame, matched: DataFrame, end: Column) -> DataFrame:
    """(cluster_id, complained) of matched clusters (cluster_id, closed_at)."""
    rows = members.select("cluster_id", "member_at").join(matched.select("cluster_id", "closed_at"), "cluster_id")
    return rows.groupBy("cluster_id").agg(gaps.complaint_after_close(F.col("closed_at"), F.col("member_at"), end).alias("complained"))


def hidden_needs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(cluster_id, mentions, explicit_requests, hiddenness) over the members' texts."""
    return rv.hiddenness(members.select("member_id", "cluster_id").join(texts, "member_id"), "cluster_id")


def rank_gaps(found: DataFrame) -> DataFrame:
    """Every gap with its place by insight, confidence and cluster id. One row a cluster, so the order is a single small sort."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("insight"), F.desc("confidence"), "cluster_id")))


def judged(members: DataFrame, items: DataFrame, end: Column, threshold: float) -> DataFrame:
    """Every cluster with its summary, its match among the items of the window's time, whether that is accepted (ok), the item's kind and age, and the verdict; null where the match settles the cluster."""
    now, _ = split_items(items, end)
    summary = matching.cluster_summary(members)
    votes = cluster_match(members, now).select("cluster_id", "item_id", "votes", "agreement", "score")
    plans = now.select("item_id", "title", "state", "created_at", "closed_at", "updated_at", "has_milestone")
    matched = votes.join(plans, "item_id")
    rows = summary.join(matched, "cluster_id", "left").join(complained_after(members, matched, end), "cluster_id", "left")
    ok = accepts(F.col("score"), threshold)
    kind = F.when(F.col("item_id").isNotNull(), gaps.temporal_class(F.col("created_at"), F.col("closed_at"), F.col("state"), end))
    rows = rows.withColumn("ok", ok).withColumn("kind", kind).withColumn("age", F.when(ok, F.round(gaps.age_days(F.col("updated_at"), F.col("created_at"), end), 4)))
    return rows.withColumn("verdict", gaps.verdict(F.col("ok"), F.col("kind"), F.col("complained"), F.col("age"), F.col("has_milestone")))


def analyse(members: DataFrame, texts: DataFrame, items: DataFrame, end: Column, threshold: float) -> DataFrame:
    """The gaps of all clusters against a roadmap, ranked; clusters whose match settles them are dropped.

    Confidence counts all clusters for its volume, also those that are dropped.
    """
    scored = gaps.confidence(judged(members, items, end, threshold), "roadmap", F.coalesce("score", F.lit(0.0)))
    found = scored.where("verdict is not null").join(hidden_needs(members, texts), "cluster_id", "left").join(later_addressed(members, items, end, threshold), "cluster_id", "left")
    found = found.withColumn("hiddenness", F.coalesce("hiddenness", F.lit(0.0))).withColumn("insight", rv.insight(F.col("hiddenness"), F.col("confidence")))
    out = found.select(
        "cluster_id", "verdict", F.when(F.col("ok"), F.col("item_id")).alias("item_id"), "score", "votes", "agreement", "age", "size", "mean_rating", "cohesion", "confidence",
        "mentions", "explicit_requests", "hiddenness", "insight", "later_id", "later_score",
    )
    return rank_gaps(out)


def analyse_alone(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The gaps of all clusters without a roadmap: none can be verified."""
    scored = gaps.confidence(matching.cluster_summary(members), "none").join(hidden_needs(members, texts), "cluster_id", "left")
    found = scored.withColumn("hiddenness", F.coalesce("hiddenness", F.lit(0.0))).withColumn("insight", rv.insight(F.col("hiddenness"), F.col("confidence"))).withColumn("verdict", F.lit("UNVERIFIED"))
    return rank_gaps(found)


def extracted(found: DataFrame, pool: int = 8, top: int = 5) -> DataFrame:
    """A wider pool of the first gaps, ranked anew by their final confidence; a top-k report."""
    rows = found.where(F.col("rank") <= max(pool, top)).drop("rank")
    return rank_gaps(rows).where(F.col("rank") <= top)


def rebuilt_confidence(weights: dict[str, float]) -> Column:
    """The confidence from stored components and weights."""
    return F.round(100 * sum((F.lit(w) * F.col(k) for k, w in weights.items()), F.lit(0.0)), 2)


def members_of(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Rows whose id, as text, is that of a member (cluster_id, member_id) of any cluster."""
    ids = members.select(F.col("member_id").cast("string").alias("__id")).distinct()
    return rows.join(ids, key.cast("string") == F.col("__id"), "left_semi")


def first_members(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """(group, ids): the first ids of each group in order; the others are left behind before any shuffle gathers a group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(member))
    first = rows.select(group, member).withColumn("__place", place).where(F.col("__place") <= most)
    return first.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("ids"))  # `most` at most


def cluster_payload(members: DataFrame, texts: DataFrame, most: int = 12) -> DataFrame:
    """(cluster_id, size, need_share, ids): how many members bear a need (one without a text or rating row counts as none), and the first ids of each."""
    need = F.coalesce(tx.need_bearing(F.col("review_text"), F.col("rating")), F.lit(False))
    said = members.select("cluster_id", "member_id").join(texts.select("member_id", "review_text", "rating"), "member_id", "left")
    shares = said.groupBy("cluster_id").agg(F.countDistinct("member_id").alias("size"), F.round(F.avg(need.cast("double")), 6).alias("need_share"))
    return shares.join(first_members(members, "cluster_id", "member_id", most), "cluster_id")


def review_evidence(cited: DataFrame, reviews: DataFrame) -> DataFrame:
    """(cluster_id, pos, evidence_id, source_type, title, snippet, url): cited reviews that exist, in cited order."""
    rows = cited.select("cluster_id", F.posexplode("ids").alias("pos", "review_id")).join(reviews, "review_id")
    name = F.col("review_id").cast("string")
    return rows.select("cluster_id", "pos", name.alias("evidence_id"), F.lit("review").alias("source_type"), F.concat(F.lit("Review "), name).alias("title"), F.substring(F.coalesce("review_text", F.lit("")), 1, 280).alias("snippet"), F.lit(None).cast("string").alias("url"))


def item_evidence(matched: DataFrame) -> DataFrame:
    """The matched item of each cluster as evidence, if it has an address: an issue by its source or the head of its id, else a page."""
    name = F.col("item_id").cast("string")
    issue = (F.col("source") == "github") | name.startswith("issue")
    text = F.coalesce("text", F.lit(""))
    rows = matched.where("url is not null and url <> ''")
    return rows.select("cluster_id", F.lit(1 << 30).alias("pos"), name.alias("evidence_id"), F.when(issue, "github_issue").otherwise("web_page").alias("source_type"), F.substring(text, 1, 120).alias("title"), F.substring(text, 1, 280).alias("snippet"), "url")


def grouped_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence counted by kind, in the fixed order of kinds; a kind without any is left out."""
    place = F.lit(len(EVIDENCE_ORDER) + 1)
    for i, kind in reversed(list(enumerate(EVIDENCE_ORDER, 1))):
        place = F.when(F.col("source_type") == kind, i).otherwise(place)
    return evidence.groupBy("cluster_id", "source_type").agg(F.count("*").alias("n")).withColumn("place", place)


def calibration(probes: DataFrame, *by: str) -> DataFrame:
    """One row over probes (positive, hit, s1, s2), or one for each value of `by`: hits, least true score, greatest runner-up and negative, overlap, threshold and margin.

    The threshold lies midway between true and negative scores, or just under the least true one where they overlap.
    """
    true = F.col("positive") & F.col("hit")
    out = probes.groupBy(*by).agg(
        F.count_if(true).alias("hits"),
        F.min(F.when(true, F.col("s1"))).alias("min_true"),
        F.max(F.when(true, F.col("s2"))).alias("max_runner"),
        F.max(F.when(~F.col("positive"), F.col("s1"))).alias("max_negative"),
        F.min(F.when(true, F.round(F.col("s1") - F.col("s2"), 4))).alias("least_margin"),
    )
    overlap = F.coalesce(F.col("max_negative") >= F.col("min_true"), F.lit(False))
    midway = F.when(~overlap & F.col("max_negative").isNotNull(), (F.col("min_true") + F.col("max_negative")) / 2).otherwise(F.col("min_true") - 0.001)
    margin = F.greatest(F.lit(0.0), F.round(F.coalesce(F.col("least_margin") - 0.003, F.lit(0.0)), 3))
    return out.select(*by, "hits", "min_true", "max_runner", "max_negative", overlap.alias("overlap"), F.round(midway, 3).alias("threshold"), margin.alias("margin"))


def summary_sentence(source: Column, n: Column, verdict: Column, need: Column) -> Column:
    """What a job found, in one sentence."""
    alone = F.concat(F.lit("Surfaced "), n.cast("string"), F.lit(" needs with no public roadmap to verify against (top: "), need, F.lit(")."))
    against = F.concat(F.lit("Found "), n.cast("string"), F.lit(" roadmap gaps (mode="), source, F.lit("); top verdict "), verdict, F.lit(" — "), need, F.lit("."))
    return F.when(n == 0, "No latent unmet needs surfaced from the available reviews.").when(source == "none", alone).otherwise(against)
