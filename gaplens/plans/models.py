"""Queries over models: spaces, clusters, null models, calibration, extraction and the sources that feed them.

What a seed or a solver decides has no SQL; tests hold it against numpy.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import analysis, chat, clusters, embedding, extraction, pages, validation
from gaplens.operators import reviews as rv
from gaplens.plans import analysis as views
from gaplens.plans.analysis import _VIEWS, _votes
from gaplens.plans.oracle import GATED, NEED_SQL, REVIEWS
from gaplens.plans.registry import WS, hint, query, sentences
from gaplens.plans.talk import _TOKENS
from gaplens.plans.web import _BARE, _PLAIN, _PLAN, _TITLE
from gaplens.sources.shared import shared_dir
from gaplens.sources.tables import items, reviews, scan_remote, table
from gaplens.sources.tables import members as plain_members

_BOUNDS = """CASE WHEN n < 8 THEN 2 ELSE greatest(2, least(14, n // 4)) END"""


@query(f"WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, least(CASE WHEN n < 40 THEN 2 WHEN n < 80 THEN 3 ELSE 4 END, {_BOUNDS})::INTEGER AS lo, ({_BOUNDS})::INTEGER AS hi, CASE WHEN n < 40 THEN 3 WHEN n < 90 THEN 4 ELSE 5 END::INTEGER AS least_size FROM c")
def ml07_k_range(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    lo, hi, least = clusters.k_bounds(F.col("n"))
    return sizes.select("source", "n", lo.alias("lo"), hi.alias("hi"), least.alias("least_size"))


@query("SELECT vec_id AS member_id, label AS cluster_id FROM embeddings WHERE vec_id % 10 <> 0 QUALIFY count(*) OVER (PARTITION BY label) >= (SELECT CASE WHEN count(*) < 40 THEN 3 WHEN count(*) < 90 THEN 4 ELSE 5 END FROM embeddings WHERE vec_id % 10 <> 0)")
def ml08_least_size(spark, d):
    return clusters.of_least_size(plain_members(spark, d).select("member_id", "cluster_id"))


@query()
def ml04_svd(spark, d):
    docs = table(spark, d, "benchmark")
    return embedding.Space.fit(docs, "item_id", "text").transform(docs, "item_id", "text")


@query()
def ml06_kmeans_select(spark, d):
    found, chosen = embedding.cluster_groups(plain_members(spark, d), F.lit("all"))
    best = chosen["all"]
    return found.select("member_id", "cluster_id", F.lit(best.k).alias("k"), F.round(F.lit(best.silhouette), 6).alias("silhouette"))


def _needs(spark, d):
    """Need-bearing reviews after the gate: (member_id, package, review_text, rating)."""
    rows = rv.rating_gate(reviews(spark, d))
    need = rows.where(tx.need_bearing(F.col("review_text"), F.col("rating")))
    return need.select(F.col("ord").alias("member_id"), "package", "review_text", "rating")


def _roadmap(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text")


@query()
def ml09_embed_cluster(spark, d):
    people = _needs(spark, d)
    space, found, best = embedding.embed_and_cluster(people, _roadmap(spark, d))
    return found.select("member_id", "cluster_id", F.lit(best.k).alias("k"), F.round(F.lit(best.silhouette), 6).alias("silhouette"), F.size("embedding").alias("components"), F.lit(space.features).alias("features"))


@query()
def ml11_matching_space(spark, d):
    controls = _needs(spark, d).where(F.col("package").isin("src1", "src2", "src3"))
    root = f"{shared_dir(spark)}/spaces-{uuid.uuid4().hex}"
    made = embedding.matching_space(_roadmap(spark, d), controls, root=root)
    again = embedding.matching_space(_roadmap(spark, d), controls, root=root)
    return again.items.select("item_id", F.size("embedding").alias("dims"), F.lit(made.roadmap_hash).alias("roadmap_hash"), F.round(F.lit(again.threshold), 6).alias("threshold"), F.lit(made.fitted).alias("fitted"), F.lit(again.fitted).alias("fitted_again"))


@query()
def ml12_null_clusters(spark, d):
    people = plain_members(spark, d).withColumn("package", F.concat(F.lit("control"), (F.col("cluster_id") % 3).cast("string")))
    return embedding.null_clusters(people.drop("cluster_id"), F.col("package")).select("package", "member_id", "cluster_id")


_PROBES = """items AS (SELECT item_id, text FROM benchmark), probes AS (SELECT item_id AS probe_id, array_to_string(regexp_extract_all(text, '[^ ]+')[4:12], ' ') AS text, item_id AS expected_id FROM benchmark WHERE item_id % 4 = 0
UNION ALL SELECT 1000000000 + doc_id, substring(text, 1, 160), NULL FROM documents WHERE doc_id % 100 = 0),
corpus AS (SELECT 'i' || item_id AS id, text FROM items UNION ALL SELECT 'p' || probe_id, text FROM probes), total AS (SELECT count(*) AS n FROM corpus)"""
_SPACES = f"""toks AS (SELECT id, {_TOKENS("text")} AS w FROM corpus), padded AS (SELECT id, ' ' || w || ' ' AS w FROM (SELECT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{WS}')) AS w FROM corpus) WHERE w <> ''),
grams AS (SELECT id, 'word' AS kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM toks UNION ALL {" UNION ALL ".join(f"SELECT id, 'char', substring(w, i, {n}) FROM padded, unnest(range(1, length(w) - {n - 2})) t(i)" for n in (3, 4, 5))}),
tf AS (SELECT id, kind, term, count(*) AS tf FROM grams GROUP BY ALL), known AS (SELECT kind, term, count(*) AS docs, sum(tf) AS most FROM tf GROUP BY kind, term), vocabulary AS (SELECT kind, term, ln((1.0::DOUBLE + n) / (1 + docs)) + 1 AS idf, row_number() OVER (PARTITION BY kind ORDER BY most DESC, term) AS p FROM known, total),
modes AS (SELECT * FROM (VALUES ('char_wb', 'char', 40000), ('word', 'word', 20000), ('union', 'word', 12000), ('union', 'char', 30000)) m(mode, kind, most)),
raw AS (SELECT mode, kind, id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (kind, term) JOIN modes USING (kind) WHERE p <= most),
even AS (SELECT mode, kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mode, kind, id)) AS w FROM raw),
weighed AS (SELECT mode, kind, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mode, id)) AS w FROM even),
pairs AS (SELECT m.mode, probe_id, expected_id, item_id, coalesce(s, 0.0) AS s FROM (SELECT DISTINCT mode FROM modes) m, probes, items LEFT JOIN (SELECT a.mode AS am, a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM weighed a JOIN weighed b ON a.mode = b.mode AND a.kind = b.kind AND a.term = b.term AND a.id[1] = 'p' AND b.id[1] = 'i' GROUP BY a.mode, a.id, b.id) x ON am = m.mode AND a = 'p' || probe_id AND b = 'i' || item_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY mode, probe_id ORDER BY round(s, 12) DESC, item_id) AS place FROM pairs),
ranks AS (SELECT mode, probe_id, any_value(expected_id) AS expected_id, max(item_id) FILTER (place = 1) AS top1, max(s) FILTER (place = 1) AS s1, coalesce(max(s) FILTER (place = 2), 0.0) AS s2, max(place) FILTER (item_id = expected_id) AS place FROM placed GROUP BY mode, probe_id)"""


def _probes(spark, d):
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), 4, 9), " ")
    true = table(spark, d, "benchmark").where("item_id % 4 = 0").select(F.col("item_id").alias("probe_id"), words.alias("text"), F.col("item_id").alias("expected_id"))
    other = table(spark, d, "documents").where("doc_id % 100 = 0").select((F.col("doc_id") + 1000000000).alias("probe_id"), F.substring("text", 1, 160).alias("text"), F.lit(None).cast("long").alias("expected_id"))
    return true.unionByName(other)


@query(f"WITH {_PROBES}, {_SPACES} SELECT mode, probe_id, expected_id, top1, round(s1, 6) AS s1, round(s2, 6) AS s2, place FROM ranks")
def agg26_retrieval(spark, d):
    found = validation.retrieval(_roadmap(spark, d), _probes(spark, d))
    return found.withColumn("s1", F.round("s1", 6)).withColumn("s2", F.round("s2", 6))


@query(f"""WITH {_PROBES}, {_SPACES}, p AS (SELECT mode, place, expected_id IS NOT NULL AS positive, coalesce(top1 = expected_id, false) AS hit, round(s1, 4) AS s1, round(s2, 4) AS s2 FROM ranks),
a AS (SELECT mode, count(*) FILTER (positive) AS probes, count(*) FILTER (positive AND hit) AS hits, min(s1) FILTER (positive AND hit) AS min_true, max(s2) FILTER (positive AND hit) AS max_runner, max(s1) FILTER (NOT positive) AS max_negative, min(round(s1 - s2, 4)) FILTER (positive AND hit) AS least, max(place) AS worst_place FROM p GROUP BY mode)
SELECT mode, probes, hits, min_true, max_runner, max_negative, coalesce(max_negative >= min_true, false) AS overlap, round(CASE WHEN NOT coalesce(max_negative >= min_true, false) AND max_negative IS NOT NULL THEN (min_true + max_negative) / 2 ELSE min_true - 0.001::DOUBLE END, 3) AS threshold,
  greatest(0.0, round(coalesce(least - 0.003::DOUBLE, 0.0), 3)) AS margin, worst_place, mode = CASE WHEN max(hits) FILTER (mode = 'union') OVER () > max(hits) FILTER (mode = 'char_wb') OVER () THEN 'union' ELSE 'char_wb' END AS recommended FROM a""")
def agg26_calibration_run(spark, d):
    return validation.calibration_run(validation.retrieval(_roadmap(spark, d), _probes(spark, d)))


_LEVEL = 0.893


@query(f"""WITH {_VIEWS}, {_votes("f")}, g AS (SELECT DISTINCT cluster_id, CASE WHEN cluster_id < 4 THEN 'real' ELSE 'control' || cluster_id % 3 END AS "group" FROM people),
c AS (SELECT "group", score, coalesce(score >= {_LEVEL}, false) AS ok FROM g LEFT JOIN f USING (cluster_id)),
r AS (SELECT "group", count(*) AS clusters, count(*) FILTER (ok) AS fired, round(avg(coalesce(score, 0.0)), 6) AS mean_top1, count(*) FILTER (NOT ok) AS ignored, count(*) FILTER (ok) AS under_prioritized, 0::BIGINT AS misunderstood, count(*) AS gaps, 0.0::DOUBLE AS validated_rate, count(*) FILTER (ok) / count(*) AS rate FROM c GROUP BY ALL)
SELECT * REPLACE (round(rate, 6) AS rate), round(avg(rate) FILTER ("group" = 'real') OVER () - avg(rate) FILTER ("group" <> 'real') OVER (), 6) AS separation, round(avg(rate) FILTER ("group" = 'real') OVER () - avg(rate) FILTER ("group" <> 'real') OVER (), 6) >= 0.35 AS clears FROM r""")
def agg27_null_test(spark, d):
    group = F.when(F.col("cluster_id") < 4, "real").otherwise(F.concat(F.lit("control"), (F.col("cluster_id") % 3).cast("string")))
    return validation.null_test(views.members(spark, d).withColumn("group", group), items(spark, d), _LEVEL, "real")


def _stub(prompt: str) -> str:
    """Stands for a model: fails, breaks its format or answers by the prompt's length."""
    n = len(prompt)
    if n % 5 == 0:
        raise OSError("no answer")
    if n % 3 == 0 and "invalid" not in prompt:
        return "Sorry, no."
    cited = prompt.split("ids): ", 1)[1].split("\n", 1)[0].split(",")
    return "```json\n" + json.dumps({"latent_need": " Need ", "verdict": "ignored" if n % 2 else "Closed", "confidence": n % 101, "confidence_justification": "as told", "one_sentence_summary": "One.", "cited_review_ids": ["x9", *cited[1:3]] if n % 4 else ["x9"]}) + "\n```"


_ASK = r"concat_ws(chr(10), 'Extract the latent need (the unspoken goal) behind these reviews.', 'Roadmap mode: github', 'Preliminary verdict: MISUNDERSTOOD', 'Cluster keywords: a, b', 'Closest roadmap item (or null): null', 'Reviews (with ids): ' || array_to_string(ids, ','), 'Return JSON: latent_need, verdict, confidence (0-100), one_sentence_summary, cited_review_ids (a subset of the given ids).')"
_RETRY = len(extraction.retry_prompt("", "no JSON"))


@query(f"""WITH f AS (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 12), g AS (SELECT source, list(doc_id::VARCHAR ORDER BY doc_id) AS ids FROM f GROUP BY source), p AS (SELECT *, length({_ASK}) AS first FROM g),
c AS (SELECT *, first % 5 <> 0 AND first % 3 = 0 AS again, CASE WHEN first % 5 <> 0 AND first % 3 = 0 THEN first + {_RETRY} ELSE first END AS n FROM p), r AS (SELECT *, n % 5 <> 0 AS used, list_filter(CASE WHEN n % 4 <> 0 THEN ids[2:3] ELSE [] END, lambda x: list_contains(ids, x)) AS known FROM c)
SELECT source AS cluster_id, CASE WHEN used THEN 'Need' ELSE 'Quote of ' || source END AS need, CASE WHEN used AND n % 2 = 1 THEN 'IGNORED' ELSE 'MISUNDERSTOOD' END AS verdict, round(CASE WHEN used THEN 0.6::DOUBLE * 50 + 0.4::DOUBLE * (n % 101) ELSE 50 END, 2) AS confidence,
  CASE WHEN used THEN (n % 101)::DOUBLE END AS llm_confidence, array_to_string(CASE WHEN used AND len(known) > 0 THEN known WHEN used THEN ids[1:3] ELSE ids[1:1] END, ',') AS cited, used AS llm_used, CASE WHEN again THEN 2 ELSE 1 END::INTEGER AS calls FROM r""")
def dom06_extraction(spark, d):
    first = analysis.first_members(table(spark, d, "documents"), "source", "doc_id", 12)
    groups = first.select(F.col("source").alias("cluster_id"), F.transform("ids", lambda x: x.cast("string")).alias("provided"))
    prompt = chat.extraction_prompt(F.array_join("provided", ","), F.lit(None).cast("string"), F.lit("MISUNDERSTOOD"), "github", F.array(F.lit("a"), F.lit("b")))
    candidates = groups.select("cluster_id", prompt.alias("prompt"), "provided", F.lit("MISUNDERSTOOD").alias("verdict"), F.lit(50.0).alias("deterministic"), F.concat(F.lit("Quote of "), F.col("cluster_id")).alias("quote"), F.col("provided")[0].alias("quote_id"))
    found = extraction.extract(candidates, _stub, f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}", "github")
    return found.select("cluster_id", "need", "verdict", "confidence", "llm_confidence", F.array_join("cited", ",").alias("cited"), "llm_used", "calls")


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 2000")
def src04_remote_scan(spark, d):
    renamed = f"{shared_dir(spark)}/remote-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", F.col("source").alias("app_id"), "lang").orderBy("doc_id").write.parquet(renamed)  # a set in order of its ids, as a scan by file expects
    return scan_remote(spark, renamed, "src3", 500)[0].withColumnRenamed("app_id", "source")


_SAYS = lambda text: f"(contains(lower(concat_ws(' ', title, {text}, url)), 'the or') OR contains(lower(concat_ws(' ', title, {text}, url)), 'the'))"
_OFFICIAL = "'github.com', 'gitlab.com', 'bitbucket.org', 'changelog.com', 'keepachangelog.com', 'medium.com', 'dev.to', 'hashnode.dev', 'substack.com', 'wordpress.com', 'blogspot.com', 'f-droid.org', 'play.google.com', 'apps.apple.com', 'en.wikipedia.org', 'reddit.com', 'www.reddit.com', 'theor.org', 'theor.com', 'www.theor.org', 'www.theor.com', 'forum.theor.org', 'example.com', 'example.org'"


@query(rf"""WITH p AS (SELECT page_id, url, trim({_TITLE}) AS title, {_BARE} AS bare, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages), q AS (SELECT *, regexp_replace(host, '^www\.', '') AS naked FROM p),
o AS (SELECT * FROM q WHERE host <> '' AND (host IN ({_OFFICIAL}) OR naked IN ({_OFFICIAL}) OR len(list_filter([{_OFFICIAL}], lambda x: ends_with(host, '.' || x) OR ends_with(naked, '.' || x))) > 0)),
s AS (SELECT *, regexp_extract_all(bare, '(?is)<(?:article|main|section)\b[^>]*>(.*?)</(?:article|main|section)\s*>', 1) AS found FROM o),
t AS (SELECT *, list_transform(CASE WHEN len(found) > 0 THEN found ELSE [bare] END, lambda x: {_PLAIN("x")}) AS sections, {_PLAIN("bare")} AS whole FROM s),
k AS (SELECT *, flatten(list_transform(sections, lambda x: CASE WHEN x <> '' AND {_SAYS("x")} THEN list_filter({sentences("x", 40, 320)}, lambda y: {_SAYS("y")}) ELSE [] END)) AS kept FROM t),
f AS (SELECT *, CASE WHEN {_SAYS("whole")} AND contains(lower(title), 'the or') THEN list_filter({sentences("whole", 40, 320)}, lambda y: {_SAYS("y")} AND (contains(lower(y), 'the') OR {hint("y", _PLAN + "|milestone")})) ELSE [] END AS rest FROM k)
SELECT url AS source_url, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE rest END, ' ') AS text, title FROM f WHERE len(kept) > 0 OR len(rest) > 0""")
def src10_page_source(spark, d):
    return pages.page_source(table(spark, d, "pages"), "The Or", domains=("example.com", "example.org"))
