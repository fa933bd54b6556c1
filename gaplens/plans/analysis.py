"""Queries over clusters and roadmap items: matches, verdicts, later items, confidence, evidence, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import analysis, gaps, matching, records
from gaplens.operators import reviews as rv
from gaplens.plans.catalog import WINDOW_END
from gaplens.plans.oracle import CLUSTERS as ORACLE_CLUSTERS
from gaplens.plans.oracle import EXPLICIT_SQL, GATED, NEED_SQL, REVIEWS
from gaplens.plans.registry import query
from gaplens.sources.tables import items, member_texts, reviews, table
from gaplens.sources.tables import members as plain_members

THRESHOLD = 0.45


def end():
    return F.lit(WINDOW_END).cast("timestamp")


_END = "TIMESTAMP '2017-06-30 00:00:00'"
_VIEWS = """raw AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS v, (DATE '2015-01-01' + CAST(vec_id * 11 % 1500 AS INTEGER))::TIMESTAMP AS created_at FROM embeddings WHERE vec_id % 10 = 0),
plans AS (SELECT *, CASE WHEN item_id % 30 = 0 THEN created_at + INTERVAL 90 DAY END AS closed_at, CASE WHEN item_id % 30 = 0 THEN 'closed' ELSE 'open' END AS state, item_id % 20 = 0 AS has_milestone,
  CASE WHEN item_id % 40 <> 0 THEN created_at + INTERVAL 1 DAY * (item_id % 400) END AS updated_at, 'Item ' || item_id AS title, CASE WHEN item_id % 50 <> 0 THEN 'https://tracker.example/' || item_id END AS url FROM raw),
drawn AS (SELECT e.vec_id AS member_id, e.label AS cluster_id, list_transform(range(1, 65), lambda k: e.embedding[k]::DOUBLE + 2 * i.v[k]) AS w, CASE WHEN vec_id % 29 <> 0 THEN (DATE '2014-01-01' + CAST(vec_id * 13 % 1500 AS INTEGER))::TIMESTAMP END AS member_at
  FROM embeddings e JOIN raw i ON i.item_id = (e.label * 2 + e.vec_id % 2) * 70 % 200 WHERE e.vec_id % 10 <> 0),
people AS (SELECT member_id, cluster_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v, member_at FROM drawn),
members AS (SELECT member_id, cluster_id, v, (member_id % 5 + 1)::DOUBLE AS rating FROM people)"""
CLUSTERS = f"{_VIEWS}{ORACLE_CLUSTERS}"


def members(spark, d):
    """Clusters with something to match: each half of a cluster is drawn towards a roadmap item of its own."""
    aim = (F.col("cluster_id") * 2 + F.col("member_id") % 2) * 70 % 200
    aims = items(spark, d).select(F.col("item_id").alias("__aim"), F.col("embedding").alias("__pull"))
    rows = plain_members(spark, d).join(aims, aim == F.col("__aim"))
    pulled = F.zip_with("embedding", "__pull", lambda x, y: x.cast("double") + 2 * y.cast("double"))
    return rows.withColumn("embedding", tx.unit(pulled)).drop("__aim", "__pull")


def _votes(name: str, wanted: str = "true", vectors: str = "m.v") -> str:
    return f"""{name}_top AS (SELECT member_id, cluster_id, item_id, list_inner_product({vectors}, i.v) AS sim FROM people m, plans i WHERE {wanted} QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY round(list_inner_product({vectors}, i.v), 12) DESC, item_id) = 1),
{name}_count AS (SELECT cluster_id, item_id, count(*) AS votes, min(member_id) AS first, avg(sim) AS score FROM {name}_top GROUP BY ALL),
{name}_all AS (SELECT cluster_id, count(*) AS members, round(avg(sim), 6) AS member_mean FROM {name}_top GROUP BY ALL),
{name}_place AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, first) AS place FROM {name}_count),
{name}_every AS (SELECT a.cluster_id, members, p.item_id, p.votes, round(p.score, 6) AS score, member_mean, q.item_id AS runner_up, coalesce(q.votes, 0) AS runner_up_votes, round(p.votes / members, 6) AS agreement,
  p.votes >= CASE WHEN members <= 1 THEN 1 ELSE greatest(2, ceil(0.3 * members)) END AS accepted FROM {name}_all a JOIN {name}_place p ON p.cluster_id = a.cluster_id AND p.place = 1 LEFT JOIN {name}_place q ON q.cluster_id = a.cluster_id AND q.place = 2),
{name} AS (SELECT * FROM {name}_every WHERE accepted)"""


_NOW = _votes("now", f"i.created_at <= {_END}")
_FUTURE = _votes("future", f"i.created_at > {_END}")
_AFTER = _votes("after", f"i.created_at <= {_END} AND (i.closed_at > {_END} OR (i.updated_at > {_END} AND i.state IN ('closed', 'shipped', 'released', 'done', 'resolved')))")
_LATER = f"{_FUTURE}, {_AFTER}, later AS (SELECT coalesce(f.cluster_id, a.cluster_id) AS cluster_id, coalesce(f.item_id, a.item_id) AS later_id, coalesce(f.score, a.score) AS later_score FROM (SELECT * FROM future WHERE score >= {THRESHOLD}) f FULL JOIN (SELECT * FROM after WHERE score >= {THRESHOLD}) a ON f.cluster_id = a.cluster_id)"
_JUDGED = f"""{_NOW}, matched AS (SELECT n.*, closed_at, state, created_at, updated_at, has_milestone, url, title FROM now n JOIN plans USING (item_id)),
complaints AS (SELECT t.cluster_id, CASE WHEN any_value(closed_at) IS NULL THEN true WHEN any_value(closed_at) > {_END} THEN false ELSE bool_or(member_at IS NULL OR member_at >= closed_at) END AS complained FROM matched t JOIN people USING (cluster_id) GROUP BY ALL),
kinds AS (SELECT t.*, complained, score >= {THRESHOLD} AS ok, CASE WHEN created_at > {_END} THEN 'future' WHEN closed_at <= {_END} OR (state = 'closed' AND closed_at IS NULL) THEN 'closed' ELSE 'open' END AS kind, greatest(0.0, (epoch_us({_END}) - epoch_us(coalesce(updated_at, created_at))) / 86400e6) AS days FROM matched t JOIN complaints USING (cluster_id)),
judged AS (SELECT s.*, k.item_id, k.score, k.votes, k.agreement, k.kind, k.url, k.title, coalesce(k.ok, false) AS ok, CASE WHEN k.ok THEN round(days, 4) END AS age, round(1 - coalesce(k.score, 0), 6) AS novelty,
  CASE WHEN NOT coalesce(k.ok, false) OR kind = 'future' THEN 'IGNORED' WHEN kind = 'closed' AND complained THEN 'MISUNDERSTOOD' WHEN kind = 'open' AND (round(days, 4) > 365 OR NOT has_milestone) THEN 'UNDER-PRIORITIZED' END AS verdict
  FROM parts s LEFT JOIN kinds k USING (cluster_id))"""
_HIDDEN = f"""hidden AS (SELECT label AS cluster_id, count(*) AS mentions, count(*) FILTER ({EXPLICIT_SQL}) AS explicit_requests, round(1 - count(*) FILTER ({EXPLICIT_SQL}) / count(*), 4) AS hiddenness FROM embeddings JOIN reviews ON vec_id = ord WHERE vec_id % 10 <> 0 GROUP BY ALL)"""
_FOUND = f"""{CLUSTERS}, {REVIEWS}, {_JUDGED}, {_LATER}, {_HIDDEN},
found AS (SELECT cluster_id, verdict, CASE WHEN ok THEN item_id END AS item_id, score, votes, agreement, age, size, mean_rating, cohesion, round(100 * (0.30::DOUBLE * volume + 0.25::DOUBLE * novelty + 0.20::DOUBLE * consistency + 0.15::DOUBLE * severity + 0.10::DOUBLE * spread), 2) AS confidence,
  mentions, explicit_requests, coalesce(hiddenness, 0.0) AS hiddenness, later_id, later_score, CASE WHEN ok THEN url END AS url, CASE WHEN ok THEN title END AS title FROM judged LEFT JOIN hidden USING (cluster_id) LEFT JOIN later USING (cluster_id) WHERE verdict IS NOT NULL),
scored_gaps AS (SELECT *, round(hiddenness * (confidence / 100), 4) AS insight FROM found),
gaps AS (SELECT *, row_number() OVER (ORDER BY insight DESC, confidence DESC, cluster_id)::INTEGER AS rank FROM scored_gaps)"""


def _analysed(spark, d):
    return analysis.analyse(members(spark, d), member_texts(spark, d), items(spark, d), end(), THRESHOLD)


@query(f"WITH {_FOUND} SELECT * EXCLUDE (url, title) FROM gaps")
def dom02_gaps(spark, d):
    return _analysed(spark, d)


@query(f"WITH {CLUSTERS}, {_JUDGED} SELECT cluster_id, CASE WHEN ok THEN item_id END AS item_id, kind, coalesce(verdict, 'none') AS verdict FROM judged")
def dom01_verdicts(spark, d):
    return analysis.judged(members(spark, d), items(spark, d), end(), THRESHOLD).select("cluster_id", F.when(F.col("ok"), F.col("item_id")).alias("item_id"), "kind", F.coalesce("verdict", F.lit("none")).alias("verdict"))


@query(f"WITH {_FOUND} SELECT verdict, count(*) AS gaps, count(later_id) AS validated FROM gaps GROUP BY ALL")
def agg18_verdict_counts(spark, d):
    return _analysed(spark, d).groupBy("verdict").agg(F.count("*").alias("gaps"), F.count("later_id").alias("validated"))


@query(f"WITH {_FOUND} SELECT rank, cluster_id, insight, confidence FROM gaps WHERE rank <= 5")
def srt03_extracted(spark, d):
    return analysis.extracted(_analysed(spark, d)).select("rank", "cluster_id", "insight", "confidence")


_ALONE = f"""{CLUSTERS}, {REVIEWS}, {_HIDDEN}, alone AS (SELECT s.*, central_id, coalesce(hiddenness, 0.0) AS hiddenness, round(coalesce(hiddenness, 0.0) * (confidence / 100), 4) AS insight FROM scored s JOIN central USING (cluster_id) LEFT JOIN hidden USING (cluster_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY insight DESC, confidence DESC, cluster_id)::INTEGER AS rank FROM alone)"""


@query(f"WITH {_ALONE} SELECT rank, cluster_id, size, confidence, insight, 'UNVERIFIED' AS verdict, central_id FROM ranked WHERE rank <= 5")
def dom03_unverified_gaps(spark, d):
    found = analysis.extracted(analysis.analyse_alone(members(spark, d), member_texts(spark, d)))
    return found.select("rank", "cluster_id", "size", "confidence", "insight", "verdict", "central_id")


@query(f"WITH {_VIEWS}, {_LATER} SELECT cluster_id, later_id, title, url, state, strftime(coalesce(closed_at, created_at, updated_at), '%Y-%m-%d') AS date FROM later JOIN plans ON item_id = later_id")
def dom04_later_payload(spark, d):
    later = analysis.later_addressed(members(spark, d), items(spark, d), end(), THRESHOLD)
    return later.join(analysis.later_payload(items(spark, d)).withColumnRenamed("item_id", "later_id"), "later_id").select("cluster_id", "later_id", "title", "url", "state", "date")


@query(f"WITH {_VIEWS}, {_FUTURE} SELECT cluster_id, item_id, score FROM future")
def joi15_future_items(spark, d):
    return analysis.cluster_match(members(spark, d), analysis.split_items(items(spark, d), end())[1]).select("cluster_id", "item_id", "score")


@query(f"WITH {_VIEWS}, {_AFTER} SELECT cluster_id, item_id, score FROM after")
def joi16_post_close(spark, d):
    return analysis.cluster_match(members(spark, d), analysis.post_close_items(items(spark, d), end())).select("cluster_id", "item_id", "score")


@query(f"WITH {_VIEWS} SELECT count(*) FILTER (created_at <= {_END}) AS now, count(*) FILTER (created_at > {_END}) AS future FROM plans")
def fil18_split_items(spark, d):
    now, future = analysis.split_items(items(spark, d), end())
    return now.agg(F.count("*").alias("now")).crossJoin(F.broadcast(future.agg(F.count("*").alias("future"))))  # one row each


@query(f"WITH {_VIEWS}, {_votes('v')} SELECT cluster_id, score >= 0.16 AS lexical, score >= 0.45 AS sentence, 0.05::DOUBLE AS margin FROM v_every")
def fil19_acceptance(spark, d):
    votes = matching.plurality(matching.top1(members(spark, d), items(spark, d)))
    (low, _), (high, margin) = analysis.active_threshold(None), analysis.active_threshold("MiniLM ")
    return votes.select("cluster_id", analysis.accepts(F.col("score"), low).alias("lexical"), analysis.accepts(F.col("score"), high).alias("sentence"), F.lit(margin).alias("margin"))


@query(f"WITH {_VIEWS}, {_votes('v')} SELECT * FROM v_every")
def agg04_plurality_vote(spark, d):
    return matching.plurality(matching.top1(members(spark, d), items(spark, d)))


@query(f"WITH {_VIEWS}, {_votes('v', 'true', 'list_transform(m.v, lambda x: x * abs(x))')} SELECT cluster_id, item_id, votes, score FROM v")
def joi19_matching_space(spark, d):
    people = members(spark, d)
    space = people.select("member_id", F.transform("embedding", lambda x: x * F.abs(x)).alias("embedding"))
    return analysis.cluster_match(people, items(spark, d), space).select("cluster_id", "item_id", "votes", "score")


@query(f"WITH {_VIEWS}, {_votes('v')}, s AS (SELECT c.k, coalesce(score, 0.0) AS score FROM (SELECT unnest(range(5, 11)) AS k) c LEFT JOIN (SELECT * FROM v_every WHERE cluster_id BETWEEN 5 AND 9) ON k = cluster_id) SELECT round(quantile_cont(score, 0.95), 6) AS threshold, 0.16::DOUBLE AS floor FROM s")
def agg15_null_percentile(spark, d):
    votes = matching.plurality(matching.top1(members(spark, d).where("cluster_id between 5 and 9"), items(spark, d))).select("cluster_id", "score")
    scores = spark.range(5, 11).select(F.col("id").cast("int").alias("cluster_id")).join(votes, "cluster_id", "left")
    none = scores.where("cluster_id < 0")
    return spark.range(1).select(F.round(F.lit(matching.null_threshold(scores)), 6).alias("threshold"), F.lit(matching.null_threshold(none)).alias("floor"))


_RATES = f"{_VIEWS}, {_votes('v')}, rates AS (SELECT CASE WHEN cluster_id < 5 THEN 'real' ELSE 'control' END AS kind, count(*) AS clusters, count(*) FILTER (score >= 0.25) AS fired, round(avg(score), 6) AS mean_top1, round(count(*) FILTER (score >= 0.25) / count(*), 6) AS fire_rate FROM v_every GROUP BY ALL)"


def _rates(spark, d):
    votes = matching.plurality(matching.top1(members(spark, d), items(spark, d)))
    return matching.fire_rate(votes, F.when(F.col("cluster_id") < 5, "real").otherwise("control"), 0.25)


@query(f"WITH {_RATES} SELECT * FROM rates")
def agg16_fire_rate(spark, d):
    return _rates(spark, d)


@query(f"WITH {_RATES} SELECT round(avg(fired / clusters) FILTER (kind = 'real') - avg(fired / clusters) FILTER (kind <> 'real'), 6) AS separation FROM rates")
def agg16_separation(spark, d):
    return matching.separation(_rates(spark, d))


_NEAR2 = "near AS (SELECT member_id, cluster_id, item_id, label, list_inner_product(m.v, i.v) AS sim, row_number() OVER (PARTITION BY member_id ORDER BY round(list_inner_product(m.v, i.v), 12) DESC, item_id) AS place FROM people m, plans i)"


@query(f"""WITH {_VIEWS}, {_NEAR2}, p AS (SELECT member_id, any_value(cluster_id) < 8 AS positive, bool_or(place = 1 AND label = cluster_id) AS hit, round(max(sim) FILTER (place = 1), 4) AS s1, round(max(sim) FILTER (place = 2), 4) AS s2 FROM near WHERE place <= 2 GROUP BY member_id),
a AS (SELECT count(*) FILTER (positive AND hit) AS hits, min(s1) FILTER (positive AND hit) AS min_true, max(s2) FILTER (positive AND hit) AS max_runner, max(s1) FILTER (NOT positive) AS max_negative, min(round(s1 - s2, 4)) FILTER (positive AND hit) AS least FROM p)
SELECT hits, min_true, max_runner, max_negative, coalesce(max_negative >= min_true, false) AS overlap, round(CASE WHEN NOT coalesce(max_negative >= min_true, false) AND max_negative IS NOT NULL THEN (min_true + max_negative) / 2 ELSE min_true - 0.001::DOUBLE END, 3) AS threshold, greatest(0.0, round(coalesce(least - 0.003::DOUBLE, 0.0), 3)) AS margin FROM a""")
def agg17_calibration(spark, d):
    people, plans = members(spark, d), items(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_label"))
    near = matching.nearest(people, plans, 2).join(labels, "item_id")
    first, second = F.col("place") == 1, F.col("place") == 2
    probes = near.groupBy("member_id", "cluster_id").agg(F.bool_or(first & (F.col("item_label") == F.col("cluster_id"))).alias("hit"), F.round(F.max(F.when(first, F.col("sim"))), 4).alias("s1"), F.round(F.max(F.when(second, F.col("sim"))), 4).alias("s2"))
    return analysis.calibration(probes.withColumn("positive", F.col("cluster_id") < 8))


@query(f"WITH {_VIEWS}, {_NEAR2}, e AS (SELECT label, min(item_id) AS expected_id FROM plans GROUP BY label) SELECT member_id, expected_id, place FROM near n JOIN e ON e.label = n.cluster_id AND e.expected_id = n.item_id")
def joi17_expected_rank(spark, d):
    first = table(spark, d, "embeddings").where("vec_id % 10 = 0").groupBy(F.col("label").alias("cluster_id")).agg(F.min("vec_id").alias("expected_id"))
    people = members(spark, d)
    return matching.expected_rank(people, items(spark, d), people.join(first, "cluster_id").select("member_id", "expected_id"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0 AND label < 5)")
def joi02_cluster_members(spark, d):
    people = plain_members(spark, d).where("cluster_id < 5")
    return analysis.members_of(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), people).select("doc_id")


@query("SELECT vec_id AS member_id, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 10 <> 0")
def joi03_member_vectors(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("review_id"))
    vectors = plain_members(spark, d).select(F.col("member_id").cast("string").alias("review_id"), "member_id", "embedding")
    return ids.join(vectors, "review_id").select("member_id", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"WITH {REVIEWS}, f AS (SELECT label AS cluster_id, vec_id FROM embeddings WHERE vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 12) SELECT cluster_id, ord AS review_id, substring(review_text, 1, 400) AS sample FROM f JOIN reviews ON ord = vec_id")
def joi05_sample_lookup(spark, d):
    cited = analysis.first_members(plain_members(spark, d), "cluster_id", "member_id", 12)
    rows = cited.select("cluster_id", F.explode("ids").alias("ord")).join(reviews(spark, d), "ord")
    return rows.select("cluster_id", F.col("ord").alias("review_id"), F.substring("review_text", 1, 400).alias("sample"))


@query(f"WITH {_VIEWS}, {REVIEWS}, {_NOW}, cited AS (SELECT label AS cluster_id, vec_id FROM embeddings WHERE vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3) SELECT cluster_id, ord::VARCHAR AS evidence_id, 'review' AS source_type, 'Review ' || ord AS title, substring(review_text, 1, 280) AS snippet, NULL AS url FROM cited JOIN reviews ON ord = vec_id UNION ALL SELECT cluster_id, item_id::VARCHAR, CASE WHEN item_id % 20 = 0 THEN 'github_issue' ELSE 'web_page' END, title, title, url FROM now JOIN plans USING (item_id) WHERE url IS NOT NULL")
def dom07_evidence(spark, d):
    return _evidence(spark, d).select("cluster_id", "evidence_id", "source_type", "title", "snippet", "url")


def _evidence(spark, d):
    people, plans = members(spark, d), items(spark, d)
    cited = analysis.first_members(people, "cluster_id", "member_id", 3)
    said = reviews(spark, d).select(F.col("ord").alias("review_id"), "review_text")
    source = F.when(F.col("item_id") % 20 == 0, "github").otherwise("web")
    matched = analysis.cluster_match(people, analysis.split_items(plans, end())[0]).join(plans.select("item_id", F.col("title").alias("text"), "url"), "item_id").withColumn("source", source)
    return analysis.review_evidence(cited, said).unionByName(analysis.item_evidence(matched))


@query(f"WITH {_VIEWS}, {_NOW}, r AS (SELECT label AS cluster_id, count(*) AS n FROM (SELECT label FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3) GROUP BY ALL) SELECT cluster_id, 'review' AS source_type, n, 1 AS place FROM r UNION ALL SELECT cluster_id, CASE WHEN item_id % 20 = 0 THEN 'github_issue' ELSE 'web_page' END, 1, CASE WHEN item_id % 20 = 0 THEN 2 ELSE 3 END FROM now JOIN plans USING (item_id) WHERE url IS NOT NULL")
def ui04_evidence_groups(spark, d):
    return analysis.grouped_evidence(_evidence(spark, d))


@query(f"""WITH {CLUSTERS}, {REVIEWS}, {GATED}, r AS (SELECT label AS cluster_id, g.*, trim(review_text) AS t, {NEED_SQL} AS need FROM gated g JOIN embeddings ON vec_id = ord WHERE vec_id % 10 <> 0),
c AS (SELECT cluster_id, trim(review_text) AS central FROM central JOIN gated ON ord = central_id),
l AS (SELECT r.cluster_id, arg_min((r.ord, r.t, r.need), r.ord) AS x FROM r JOIN c USING (cluster_id) WHERE central <> '' AND (t = central OR starts_with(t, substring(central, 1, 80))) GROUP BY ALL),
n AS (SELECT cluster_id, arg_min((ord, t), ord) FILTER (need) AS n, arg_min((ord, t), ord) FILTER (t <> '') AS f FROM r GROUP BY ALL)
SELECT cluster_id, CASE WHEN x[3] THEN x[1] ELSE coalesce(n[1], f[1]) END AS ord, coalesce(CASE WHEN x[3] THEN x[2] ELSE coalesce(n[2], f[2]) END, '(no review text)') AS quote FROM n LEFT JOIN l USING (cluster_id)""")
def dom05_representative(spark, d):
    people = members(spark, d)
    rows = rv.rating_gate(reviews(spark, d)).join(people.select(F.col("member_id").alias("ord"), "cluster_id"), "ord")
    central = matching.cluster_summary(people).select("cluster_id", F.col("central_id").alias("ord")).join(rows.select("ord", F.col("review_text").alias("central")), "ord").drop("ord")
    rows = rows.join(central, "cluster_id", "left")
    return records.representative(rows, "cluster_id", F.col("review_text"), tx.need_bearing(F.col("review_text"), F.col("rating")), F.coalesce("central", F.lit("")))


@query(f"WITH {CLUSTERS} SELECT cluster_id, row_number() OVER (ORDER BY size DESC, mean_rating, cluster_id)::INTEGER AS by_size, row_number() OVER (ORDER BY mean_rating DESC, cluster_id)::INTEGER AS by_rating, round(size / greatest(sum(size) OVER (), 1), 6) AS share FROM summary")
def srt01_cluster_order(spark, d):
    from pyspark.sql import Window

    found = matching.cluster_summary(members(spark, d))
    total = found.agg(F.greatest(F.sum("size"), F.lit(1)).alias("total"))
    by_size = F.row_number().over(Window.orderBy(F.desc("size"), "mean_rating", "cluster_id"))
    by_rating = F.row_number().over(Window.orderBy(F.desc("mean_rating"), "cluster_id"))
    return found.crossJoin(F.broadcast(total)).select("cluster_id", by_size.alias("by_size"), by_rating.alias("by_rating"), F.round(F.col("size") / F.col("total"), 6).alias("share"))  # one row


@query(f"WITH {CLUSTERS} SELECT cluster_id, confidence, confidence AS rebuilt FROM scored")
def agg07_rebuilt_confidence(spark, d):
    found = gaps.confidence(matching.cluster_summary(members(spark, d)), "none")
    weights = dict(zip(("volume", "novelty", "consistency", "severity", "spread"), gaps.WEIGHTS["none"], strict=True))
    return found.select("cluster_id", "confidence", analysis.rebuilt_confidence(weights).alias("rebuilt"))


@query(f"WITH {REVIEWS}, h AS (SELECT package, count(*) AS mentions, count(*) FILTER ({EXPLICIT_SQL}) AS explicit_requests FROM reviews GROUP BY ALL), b AS (SELECT *, 1 - explicit_requests / mentions AS base FROM h), x AS (SELECT package, mentions, explicit_requests, round(base, 4) AS hiddenness, round(base + (1 - base) * 0.25::DOUBLE, 4) AS across FROM b) SELECT *, round(hiddenness * (mentions % 100 / 100.0::DOUBLE), 4) AS insight FROM x")
def agg09_insight(spark, d):
    rows = reviews(spark, d)
    one = rv.hiddenness(rows, "package")
    many = rv.hiddenness(rows, "package", cross_cluster=True).select("package", F.col("hiddenness").alias("across"))
    return one.join(many, "package").select("package", "mentions", "explicit_requests", "hiddenness", "across", rv.insight(F.col("hiddenness"), F.col("mentions") % 100).alias("insight"))


@query(f"WITH {REVIEWS}, {GATED} SELECT count(*) FILTER ({NEED_SQL}) AS need_bearing, count(*) FILTER (NOT {NEED_SQL}) AS other FROM gated")
def agg13_need_split(spark, d):
    rows = rv.with_need(rv.rating_gate(reviews(spark, d)))
    return rv.need_split(rows, F.count_if("need_bearing"))


@query("""WITH d AS (SELECT doc_id, DATE '2014-01-01' + (doc_id * 7 % 1500)::INTEGER AS day FROM documents), w AS (SELECT day, CASE WHEN doc_id % 3 = 0 THEN strftime(day, '%B %d %Y') WHEN doc_id % 11 = 0 THEN 'nan' ELSE strftime(day, '%Y-%m-%d') END AS written FROM d)
SELECT coalesce(strftime(min(day), '%Y-%m-%d'), '2020-02-02') AS window_start, coalesce(strftime(max(day), '%Y-%m-%d'), '2020-02-02') AS window_end, count(day) AS dated FROM w WHERE written = 'never'""")
def agg05_empty_window(spark, d):
    return rv.review_window(reviews(spark, d).where("created_at = 'never'"), F.lit("2020-02-02").cast("timestamp"))


_STATS = "SELECT source, count(*) % 3 AS n FROM documents GROUP BY source"


@query(f"SELECT source, CASE WHEN n = 0 THEN 'No latent unmet needs surfaced from the available reviews.' WHEN source IN ('src1', 'src2', 'src3') THEN 'Surfaced ' || n || ' needs with no public roadmap to verify against (top: Need).' ELSE 'Found ' || n || ' roadmap gaps (mode=github); top verdict IGNORED — Need.' END AS summary FROM ({_STATS})")
def str11_summary(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg((F.count("*") % 3).alias("n"))
    mode = F.when(F.col("source").isin("src1", "src2", "src3"), "none").otherwise("github")
    return rows.select("source", analysis.summary_sentence(mode, F.col("n"), F.lit("IGNORED"), F.lit("Need")).alias("summary"))


@query("SELECT o_orderkey, round(greatest(0.0, (epoch_us(TIMESTAMP '1996-01-01') - epoch_us(o_orderdate)) / 86400e6), 4) AS age_days FROM orders")
def dat03_age_at(spark, d):
    now = F.lit("1996-01-01").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.round(gaps.age_days(F.lit(None).cast("timestamp"), F.col("o_orderdate"), now), 4).alias("age_days"))


@query("""WITH w AS (SELECT o_custkey, min(o_orderdate) AS a, CASE WHEN o_custkey % 3 = 0 THEN min(o_orderdate) ELSE max(o_orderdate) END AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%b %Y') WHEN year(a) = year(b) THEN strftime(a, '%b') || '–' || strftime(b, '%b %Y') ELSE strftime(a, '%b %Y') || ' – ' || strftime(b, '%b %Y') END AS label FROM w""")
def ui05_window_label(spark, d):
    first, last = F.min("o_orderdate"), F.max("o_orderdate")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(first.alias("a"), last.alias("z"))
    b = F.when(F.col("o_custkey") % 3 == 0, F.col("a")).otherwise(F.col("z"))
    return rows.select("o_custkey", tx.window_label(F.when(F.col("o_custkey") % 7 != 0, F.col("a")), b).alias("label"))


@query("SELECT o_orderkey, CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * floor(abs(v) * pow(10.0, 2 - floor(log10(abs(v)))) + 0.5) / pow(10.0, 2 - floor(log10(abs(v)))) END AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice / pow(10.0, o_orderkey % 7) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END END AS v FROM orders)")
def ui06_significant(spark, d):
    k = F.col("o_orderkey")
    v = F.when(k % 10 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / F.pow(F.lit(10.0), (k % 7).cast("double")) * F.when(k % 2 == 0, 1).otherwise(-1))
    return table(spark, d, "orders").select("o_orderkey", tx.significant(v).alias("shown"))


@query(f"""WITH {REVIEWS}, {GATED}, m AS (SELECT label AS cluster_id, vec_id FROM embeddings WHERE vec_id % 10 <> 0), n AS (SELECT ord, {NEED_SQL} AS need FROM gated)
SELECT cluster_id, count(*) AS size, round(avg(CASE WHEN need THEN 1.0::DOUBLE ELSE 0 END), 6) AS need_share, array_to_string(list(vec_id ORDER BY vec_id)[1:12], ',') AS ids FROM m LEFT JOIN n ON ord = vec_id GROUP BY cluster_id""")
def agg01_cluster_payload(spark, d):
    said = rv.rating_gate(reviews(spark, d)).select(F.col("ord").alias("member_id"), "review_text", "rating")
    found = analysis.cluster_payload(plain_members(spark, d), said)
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
