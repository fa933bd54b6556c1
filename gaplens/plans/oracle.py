"""DuckDB SQL for the queries of gaplens.plans.queries, over the same tables."""

# What the queries must agree with, written out; nothing is taken from the engine.
WANT = (
    r"wish|would love|would like|would be (nice|great|good|better|awesome)|hope|please add|please (fix|make|include)|missing|lack of|lacks?|"
    r"no way to|can't|cant|cannot|doesn't let|should (have|be able|allow|support)|if only|need(s)? (a|an|to|the|more|better)|feature request|"
    r"suggest(ion)?|add(ed|ing)? support|it('?d| would) (be|help)|looking for|miss(ing)? (a|an|the)|faster .+ would|go to at least|at least \d|leads to|would (prefer|appreciate)"
)
PROBLEM = (
    r"bug|broken|crash(es|ed|ing)?|fail(s|ed|ing)?|error|freeze|frozen|stuck|unusable|doesn'?t work|does not work|won'?t work|not work|stopped working|"
    r"keeps? (crashing|failing|stopping)|force.?close|anr|slow network|pause when resuming|never works|always (fails|crashes)|glitch"
)
NEGATED = r"(without|never|no)\s+(any\s+)?(crash(es|ed|ing)?|fail(s|ed|ing)?|error|bug|glitch|freeze|freezing)"
ASKS = (
    "please add", "please make", "would be nice if", "wish there was", "wish it had", "should have", "should add", "needs a", "need an option",
    "feature request", "add a feature", "hope you add", "please include", "why isn't there", "why is there no", "no option to", "there should be",
)
LEADS = ("I wish it had ", "It runs without any crash ", "The sync keeps failing ", "", "Please add dark mode ", "It never works ", "", "There is no option to export ")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_END = "TIMESTAMP '2017-06-30 00:00:00'"
REVIEWS = f"""reviews AS (
  SELECT doc_id AS ord, source AS package, [{", ".join(map(_text, LEADS))}][doc_id % 8 + 1] || coalesce(text, '') AS review_text,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN doc_id % 2 = 0 THEN doc_id % 5 + 0.5 ELSE doc_id % 5 + 1.0 END::DOUBLE AS number,
    DATE '2014-01-01' + CAST(doc_id * 7 % 1500 AS INTEGER) AS day, doc_id % 3 <> 0 AND doc_id % 11 = 0 AS undated
  FROM documents)"""
GATED = """gated AS (SELECT *, coalesce(number, 3.0) AS rating FROM reviews WHERE number IS NULL OR isnan(number) OR number < 5)"""
_REVIEWS = f"{REVIEWS}, {GATED}"
_WS = r"[ \t\n\r\f\x0B]+"
_NORM = rf"trim(regexp_replace(lower(review_text), '{_WS}', ' ', 'g'))"
_WORDS = r"len(regexp_extract_all(review_text, '[\p{L}\p{M}\p{N}_]+'))"
_B, _E = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"
_NEED = f"""(trim(review_text) <> '' AND (coalesce(NOT isnan(rating) AND rating <= 3.0, false)
  OR regexp_matches(review_text, {_text(f"(?i){_B}({WANT}){_E}")})
  OR regexp_matches(regexp_replace(review_text, {_text(f"(?i){_B}{NEGATED}{_E}")}, ' ', 'g'), {_text(f"(?i){_B}({PROBLEM}){_E}")})))"""
_SHOW = "CASE WHEN isnan(rating) THEN -1.0 ELSE rating END"
_MEMBERS = """members AS (SELECT vec_id AS member_id, label AS cluster_id, CAST(embedding AS DOUBLE[]) AS v, (vec_id % 5 + 1)::DOUBLE AS rating FROM embeddings WHERE vec_id % 10 <> 0),
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, (DATE '2015-01-01' + CAST(vec_id * 11 % 1500 AS INTEGER))::TIMESTAMP AS created_at FROM embeddings WHERE vec_id % 10 = 0)"""
_TOP = f"""{_MEMBERS}, sims AS (SELECT member_id, cluster_id, item_id, list_inner_product(m.v, i.v) AS sim FROM members m, items i),
ranks AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY sim DESC, item_id) AS r FROM sims), top AS (SELECT member_id, cluster_id, item_id, sim FROM ranks WHERE r = 1)"""
_VOTES = f"""{_TOP}, votes AS (SELECT cluster_id, item_id, count(*) AS votes, min(member_id) AS first, avg(sim) AS score FROM top GROUP BY ALL),
totals AS (SELECT cluster_id, count(*) AS members FROM top GROUP BY ALL),
plurality AS (SELECT cluster_id, members, item_id, votes, round(score, 6) AS score, round(votes / members, 6) AS agreement, votes >= CASE WHEN members <= 1 THEN 1 ELSE greatest(2, ceil(0.3 * members)) END AS accepted
  FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, first) AS r FROM votes) JOIN totals USING (cluster_id) WHERE r = 1)"""
_CLUSTERS = f"""{_MEMBERS}, cells AS (SELECT cluster_id, i, avg(v[i]) AS x FROM members, range(1, 65) t(i) GROUP BY ALL),
means AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM cells GROUP BY ALL),
near AS (SELECT m.*, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) AS sim FROM members m JOIN means USING (cluster_id)),
central AS (SELECT cluster_id, member_id AS central_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, member_id) AS r FROM near) WHERE r = 1),
summary AS (SELECT cluster_id, count(*) AS size, round(avg(sim), 6) AS cohesion, round(avg(rating), 6) AS mean_rating, round(count(DISTINCT rating) / 5, 6) AS rating_spread FROM near GROUP BY ALL),
parts AS (SELECT *, round(ln(1 + size) / ln(1 + greatest(max(size) OVER (), 1)), 6) AS volume, round(least(1, greatest(0, cohesion)), 6) AS consistency,
  round(least(1, greatest(0, (5 - mean_rating) / 4)), 6) AS severity, round(least(1, greatest(0, rating_spread)), 6) AS spread FROM summary),
scored AS (SELECT *, round(100 * (0.35::DOUBLE * volume + 0.30::DOUBLE * consistency + 0.20::DOUBLE * severity + 0.15::DOUBLE * spread), 2) AS confidence FROM parts)"""
_DATED = f"dated AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS closed, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state FROM orders)"
_KIND = f"CASE WHEN {{created}} > {_END} THEN 'future' WHEN {{closed}} <= {_END} OR (state = 'closed' AND {{closed}} IS NULL) THEN 'closed' ELSE 'open' END"
_EXPLICIT = " OR ".join(f"contains(lower(review_text), {_text(m)})" for m in ASKS)
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
_BARE = r"regexp_replace(html, '(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g')"

ORACLE_SQL: dict[str, str] = {
    "fil01_min_words": f"WITH {_REVIEWS} SELECT ord FROM reviews WHERE {_WORDS} >= 10",
    "fil03_rating_gate": f"WITH {_REVIEWS} SELECT ord, {_SHOW} AS rating FROM gated",
    "fil05_first_wins_dedupe": f"SELECT min(doc_id) AS ord FROM (SELECT doc_id, coalesce(text, '') AS review_text FROM documents) GROUP BY {_NORM}",
    "fil06_ingest_quota": f"WITH {_REVIEWS}, k AS (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY ord) AS r FROM gated WHERE {_WORDS} >= 10) SELECT ord, {_SHOW} AS rating FROM k WHERE r = 1 ORDER BY ord LIMIT 200",
    "fil07_need_bearing": f"WITH {_REVIEWS} SELECT ord, {_NEED} AS need_bearing FROM gated",
    "agg10_need_stats": f"WITH {_REVIEWS} SELECT count(*) AS reviews_total, count(*) FILTER ({_NEED}) AS reviews_need_bearing FROM gated",
    "fil17_temporal_class": f"WITH {_DATED} SELECT o_orderkey, {_KIND.format(created='o_orderdate', closed='closed')} AS kind, round(greatest(0.0, (epoch_us({_END}) - epoch_us(o_orderdate)) / 86400e6), 4) AS age_days FROM dated",
    "fil21_citation_subset": "SELECT conv_id, turn, array_to_string(list_filter([turn, conv_id % 5, turn, 99], lambda x: list_contains(range(0, conv_id % 4 + 1), x)), ',') AS kept FROM conversations",
    "joi01_similarity_top1": f"WITH {_TOP} SELECT member_id, cluster_id, item_id, round(sim, 6) AS sim FROM top",
    "joi04_evidence_lookup": "SELECT doc_id, substring(text, 1, 280) AS snippet, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "joi06_nested_read": "WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity::DECIMAL(18,2)) AS qty FROM lineitem GROUP BY ALL) SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(lines), 0)::BIGINT AS lines, coalesce(sum(qty)::DOUBLE, 0.0) AS qty FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL",
    "joi12_upsert": "WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS k, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 7 = 0) SELECT coalesce(k, c_custkey) AS c_custkey, c_name, round(coalesce(b, c_acctbal), 2) AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k",
    "joi13_anti_delete": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "joi14_complaint_after_close": f"WITH {_DATED} SELECT o_orderkey, CASE WHEN max(closed) IS NULL THEN true WHEN max(closed) > {_END} THEN false ELSE coalesce(bool_or(l_shipdate IS NULL OR l_shipdate >= closed), false) END AS complained FROM dated JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "agg01_cluster_summary": f"WITH {_CLUSTERS} SELECT s.*, central_id FROM summary s JOIN central USING (cluster_id)",
    "agg05_review_window": f"WITH {_REVIEWS} SELECT strftime(min(day) FILTER (NOT undated), '%Y-%m-%d') AS window_start, strftime(max(day) FILTER (NOT undated), '%Y-%m-%d') AS window_end, count(*) FILTER (NOT undated) AS dated FROM reviews",
    "agg06_confidence": f"WITH {_CLUSTERS} SELECT cluster_id, volume, consistency, severity, spread, confidence FROM scored",
    "agg08_hiddenness": f"WITH {_REVIEWS} SELECT package, count(*) AS mentions, count(*) FILTER ({_EXPLICIT}) AS explicit_requests, round(1 - count(*) FILTER ({_EXPLICIT}) / count(*), 4) AS hiddenness FROM reviews GROUP BY ALL",
    "agg11_rating_histogram": f"WITH {_REVIEWS} SELECT b::INTEGER AS bucket, count(ord) AS n FROM range(1, 6) t(b) LEFT JOIN (SELECT * FROM gated WHERE NOT isnan(rating)) ON round_even(rating, 0) = b GROUP BY b",
    "agg12_year_zero_fill": "WITH o AS (SELECT year(o_orderdate)::INTEGER AS y FROM orders WHERE year(o_orderdate) <> 1995) SELECT t.y::INTEGER AS year, count(o.y) AS n FROM (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM o) t LEFT JOIN o ON o.y = t.y GROUP BY t.y",
    "agg14_package_profile": f"WITH {_REVIEWS} SELECT package, count(*) AS reviews, round(avg(rating), 6) AS avg_stars, arg_min(substring(review_text, 1, 120), ord) FILTER (trim(review_text) <> '') AS sample FROM gated WHERE NOT isnan(rating) GROUP BY package",
    "win03_margin": f"WITH {_TOP} SELECT member_id, max(item_id) FILTER (r = 1) AS item_id, round(max(sim) FILTER (r = 1), 6) AS s1, round(coalesce(max(sim) FILTER (r = 2), 0.0), 6) AS s2 FROM ranks GROUP BY member_id",
    "win06_last_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4",
    "set01_corpus_union": "SELECT doc_id AS id, length(text)::INTEGER AS n, 'review' AS corpus FROM documents UNION ALL SELECT item_id, length(text)::INTEGER, 'item' FROM benchmark",
    "set03_override_union": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part",
    "src10_page_text": rf"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace({_BARE}, '(?s)<[^>]*>', ' ', 'g'), '{_WS}', ' ', 'g')) AS text FROM pages",
    "str04_sentences": rf"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 40 AND 320) AS parts FROM documents) SELECT doc_id, (i - 1)::INTEGER AS i, parts[i] AS sentence FROM s, unnest(range(1, len(parts) + 1)) t(i)",
    "hsh01_review_id": "SELECT doc_id, substring(sha1(coalesce(source, 'None') || '|2.0|None|' || lower(trim(coalesce(text, 'None')))), 1, 16) AS review_id, 'web-' || substring(sha1(source), 1, 10) AS evidence_id FROM documents",
    "jsn01_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "ui01_weighted_histogram": f"WITH {_CLUSTERS}, h AS (SELECT floor(mean_rating + 0.5)::INTEGER AS stars, sum(size)::BIGINT AS n FROM summary GROUP BY ALL) SELECT stars, n, round(100 * n / sum(n) OVER (), 4) AS percent FROM h",
}

_WANTS = f"regexp_matches(review_text, {_text(f'(?i){_B}({WANT}){_E}')})"
_GRAMS = " UNION ALL ".join(f"SELECT item_id, substring(w, i, {n}) AS term FROM padded, unnest(range(1, length(w) - {n - 2})) t(i)" for n in (3, 4, 5))

ORACLE_SQL |= {
    "fil09_version_title": f"SELECT p_partkey, regexp_matches(concat('v', p_size, '.', p_partkey % 7, CASE p_partkey % 3 WHEN 0 THEN '-rc1' WHEN 1 THEN ' beta' ELSE '' END), '(?i)^v?[0-9]+([.][0-9]+)+([-._]?[a-z0-9]+)?$') AS is_version FROM part",
    "fil15_junk_gate": "SELECT doc_id, length(t) < 40 OR length(t) - length(replace(t, '-', '')) > 12 AS junk FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "fil20_evidence_required": "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank, c_custkey FROM (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_acctbal DESC, c_custkey LIMIT 5)",
    "fil24_completed_job": "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1",
    "joi18_want_rate": f"WITH {_REVIEWS} SELECT package, count(*) AS n, count(*) FILTER ({_WANTS}) AS wants, round(count(*) FILTER ({_WANTS}) / count(*), 6) AS rate FROM reviews GROUP BY ALL",
    "agg19_degraded_set": "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS notes FROM documents GROUP BY ALL",
    "agg21_upload_summary": f"WITH {_REVIEWS} SELECT package, round(avg(rating), 2) AS stars, arg_min(substring(review_text, 1, 280), ord) AS sample FROM gated WHERE NOT isnan(rating) GROUP BY package",
    "agg22_open_and_total": "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY ALL",
    "agg23_document_frequency": r"SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))) AS term FROM documents) GROUP BY term",
    "ml01_char_tfidf": f"""WITH padded AS (SELECT item_id, ' ' || w || ' ' AS w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{_WS}')) AS w FROM benchmark) WHERE w <> ''), grams AS ({_GRAMS}),
      tf AS (SELECT item_id, term, count(*) AS tf FROM grams GROUP BY ALL), terms AS (SELECT term, sum(tf) AS total, count(*) AS docs FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 40000),
      raw AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + docs)) + 1) AS w FROM tf JOIN terms USING (term))
      SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM raw""",
    "win09_top_three": f"WITH {_TOP} SELECT member_id, item_id, r::INTEGER AS place FROM ranks WHERE r <= 3",
    "str06_slug": r"SELECT p_partkey, 'custom.' || regexp_replace(regexp_replace(lower('(' || p_name || ')'), '[^a-z0-9]+', '.', 'g'), '^\.|\.$', '', 'g') AS slug FROM part",
    "str14_fence": "SELECT event_id, trim(props) AS props FROM events",
    "prj04_flat_row": "SELECT doc_id, substring(array_to_string(l[1:12], ' | '), 1, 2000) AS flat, len(l)::INTEGER AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)",
    "jsn02_bounds": "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 100 AND length(props) <= 500",
    "hsh03_config_hash": "SELECT c_custkey, substring(sha256(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name)::VARCHAR), 1, 24) AS hash FROM customer",
    "src15_split_urls": "SELECT page_id, CASE WHEN url = 'http://a.org' THEN url ELSE url || ' http://a.org' END AS urls FROM pages",
    "ui03_contributions": f"WITH {_CLUSTERS} " + " UNION ALL ".join(f"SELECT cluster_id, '{k}' AS part, round(100 * {w}::DOUBLE * {k}, 2) AS points FROM scored" for k, w in (("volume", 0.35), ("consistency", 0.30), ("severity", 0.20), ("spread", 0.15))),
}

CLUSTERS, EXPLICIT_SQL, NEED_SQL = _CLUSTERS.removeprefix(_MEMBERS), _EXPLICIT, _NEED
