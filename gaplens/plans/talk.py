"""Queries over texts, talks and terms: issue texts, evidence packs, replies, keywords, lexical weights and spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import analysis, chat, embedding, records, terms
from gaplens.operators import reviews as rv
from gaplens.plans.oracle import GATED, NEED_SQL, REVIEWS
from gaplens.plans.registry import WS, query
from gaplens.sources.tables import members, reviews, table

_FORM = "concat('<!-- a', chr(10), 'hint -->', chr(10), '### Environment of mine', chr(10), '- [x] done', chr(10), '- [ ] I have used the search function and more', chr(10), 'I have read the relevant documentation', chr(10), 'App version: 1.2', chr(10), coalesce(text, ''))"
_CLEAN = _FORM
for _part in (
    r"(?s)<!--.*?-->", r"(?im)^###\s*(Checklist|Environment|App version|Device model|Android version|AntennaPod version|How to reproduce|Steps to reproduce)\b.*$",
    r"(?im)^\s*[-*]?\s*\[[ xX]?\]?\s*I have used the search function.*$", r"(?im)^\s*[-*]?\s*\[[ xX]?\]?\s*I have read (the )?(relevant )?(documentation|wiki).*$",
    r"(?m)^\s*[-*]\s*\[[ xX]\]\s*.*$", r"(?im)^\s*(Android version|AntennaPod version|App version|Device model|Device|OS version|Free space)\s*:.*$",
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_part}', ' ', 'g')"
_BODY = f"trim(regexp_replace({_CLEAN}, '{WS}', ' ', 'g'))"


def _form():
    return F.concat(F.lit("<!-- a\nhint -->\n### Environment of mine\n- [x] done\n- [ ] I have used the search function and more\nI have read the relevant documentation\nApp version: 1.2\n"), F.coalesce("text", F.lit("")))


@query(f"SELECT conv_id, turn, {_BODY} AS body FROM conversations")
def str02_issue_body(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", records.issue_body(_form()).alias("body"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter([trim(role), trim(role), trim(role), b], lambda x: x <> ''), '. ') AS text FROM (SELECT *, {_BODY} AS b FROM conversations)")
def str03_issue_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", records.issue_text(F.col("role"), _form()).alias("text"))


@query("SELECT event_id, event_id % 3 = 0 AS kept FROM events")
def fil25_pull_request_exclusion(spark, d):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, '{"number": 1}').when(kind == 1, '{"number": 2, "pull_request": {"url": "x"}}').otherwise('{"pull_request": null}')
    return table(spark, d, "events").select("event_id", records.is_issue(raw).alias("kept"))


@query("SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def jsn01_salvaged(spark, d):
    kind, p = F.col("event_id") % 5, F.col("props")
    raw = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\nDone."))).when(kind == 2, F.concat(F.lit("So: "), p, F.lit(" end"))).when(kind == 3, F.lit("no {json here")).otherwise(F.concat(F.lit("```\n"), p, F.lit("```")))
    return table(spark, d, "events").select("event_id", F.get_json_object(chat.salvaged_json(raw), "$.k").cast("int").alias("k"))


@query("SELECT doc_id, coalesce(length(text) <= 500 AND length(source) <= 64 AND doc_id % 120 - 5 BETWEEN 0 AND 100 AND length(lang) <= 2000 AND doc_id % 40 <= 32, false) AS ok FROM documents")
def jsn02_limits(spark, d):
    cited = F.array_repeat(F.lit("r"), (F.col("doc_id") % 40).cast("int"))
    return table(spark, d, "documents").select("doc_id", chat.bounded(F.col("text"), F.col("source"), F.col("doc_id") % 120 - 5, F.col("lang"), cited).alias("ok"))


@query("""WITH c AS (SELECT conv_id, turn, unnest([1, 2, 3, 4]) AS k FROM conversations), f AS (SELECT conv_id, turn, k, CASE WHEN k % 2 = 1 AND turn % 4 < 2 THEN turn % 4 WHEN k = 4 THEN 1 END AS r, CASE k WHEN 1 THEN 'e1' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS e, CASE WHEN k = 1 THEN 'said' ELSE '' END AS q FROM c)
SELECT conv_id, turn, coalesce(string_agg(coalesce(r::VARCHAR, '-') || '/' || coalesce(e, '-') || '/' || q, ' ' ORDER BY k) FILTER (q <> '' OR r IS NOT NULL OR coalesce(e, '') <> ''), '') AS kept FROM f GROUP BY conv_id, turn""")
def fil22_citation_repair(spark, d):
    n = (F.col("turn") % 4).cast("int")
    cite = lambda rank, evidence, quote: F.struct(rank.cast("int").alias("gap_rank"), evidence.cast("string").alias("evidence_id"), F.lit(quote).alias("quote"))
    given = F.array(cite(n, F.lit("e1"), "said"), cite(F.lit(9), F.lit("gone"), ""), cite(n, F.lit(None), ""), cite(F.lit(1), F.lit(""), ""))
    kept = chat.repaired_citations(given, F.array(F.lit(0), F.lit(1)), F.array(F.lit("e1"), F.lit("e2")))
    shown = F.transform(kept, lambda c: F.concat_ws("/", F.coalesce(c["gap_rank"].cast("string"), F.lit("-")), F.coalesce(c["evidence_id"], F.lit("-")), c["quote"]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(shown, " ").alias("kept"))


_PACK = """l AS (SELECT l_orderkey, l_linenumber, concat_ws(chr(10), '### Gap #' || l_linenumber, 'Need: Need of ' || l_partkey, 'Verdict: ' || l_returnflag, 'Confidence: ' || l_suppkey % 100, 'Hiddenness: None', 'Insight score: None', 'Summary: It''s so', 'Keywords: a, b',
  CASE WHEN l_partkey % 2 = 0 THEN 'Surface complaints: slow; hot' END, CASE WHEN l_partkey % 3 = 0 THEN 'Matched roadmap: Plan (sim=0.5, state=open)' END, 'Evidence:', '  - [review] id=r' || l_suppkey || ' review_id=' || l_suppkey || ' title=''Review ' || l_suppkey || ''' snippet="It''s ' || l_linestatus || '" url=', '') AS b FROM lineitem),
j AS (SELECT l_orderkey, trim(string_agg(b, chr(10) ORDER BY l_linenumber, b), chr(10)) AS b FROM (SELECT DISTINCT * FROM l) GROUP BY l_orderkey),
p AS (SELECT o_orderkey, concat_ws(chr(10), 'App: Customer ' || o_custkey || ' (com.acme.app' || o_custkey || ')', 'Roadmap source: none', 'Summary: ', 'Stats: reviews=5', '', 'GAPS AND EVIDENCE:', b) AS pack FROM orders LEFT JOIN j ON l_orderkey = o_orderkey)"""


@query(f"WITH {_PACK} SELECT o_orderkey, CASE WHEN length(pack) <= 900 THEN pack ELSE rtrim(substring(pack, 1, 860), chr(10) || ' ') || chr(10) || chr(10) || '[truncated for length]' END AS pack FROM p")
def str12_evidence_pack(spark, d):
    text = lambda c: F.col(c).cast("string")
    some = lambda wanted, *values: F.when(wanted, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>"))
    null = F.lit(None).cast("string")
    evidence = F.struct(F.concat(F.lit("r"), text("l_suppkey")).alias("id"), F.lit("review").alias("kind"), text("l_suppkey").alias("review_id"), F.concat(F.lit("Review "), text("l_suppkey")).alias("title"), F.concat(F.lit("It's "), F.col("l_linestatus")).alias("snippet"), null.alias("url"))
    gap = F.struct(
        F.col("l_linenumber").alias("rank"), F.concat(F.lit("Need of "), text("l_partkey")).alias("need"), F.col("l_returnflag").alias("verdict"), (F.col("l_suppkey") % 100).cast("string").alias("confidence"), null.alias("hiddenness"), null.alias("insight"),
        F.lit("It's so").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("keywords"), some(F.col("l_partkey") % 2 == 0, "slow", "hot").alias("surfaces"), F.array().cast("array<string>").alias("workarounds"),
        F.when(F.col("l_partkey") % 3 == 0, "Plan").alias("matched"), F.lit("0.5").alias("similarity"), F.lit("open").alias("state"), F.array(evidence).alias("evidence"),
    )
    listed = table(spark, d, "lineitem").select("l_orderkey", gap.alias("gap")).distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))  # a job's gaps
    rows = table(spark, d, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pack = chat.evidence_pack(F.concat(F.lit("Customer "), text("o_custkey")), F.concat(F.lit("com.acme.app"), text("o_custkey")), F.lit(""), null, F.lit("reviews=5"), F.coalesce("gaps", F.array().cast(listed.schema["gaps"].dataType)), 900)
    return rows.select("o_orderkey", pack.alias("pack"))


@query("SELECT source, concat_ws(chr(10), 'Extract the latent need (the unspoken goal) behind these reviews.', 'Roadmap mode: none', 'Preliminary verdict: UNVERIFIED', 'Cluster keywords: a, b', 'Closest roadmap item (or null): null', 'Reviews (with ids): ' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), 'Return JSON: latent_need, verdict, confidence (0-100), one_sentence_summary, cited_review_ids (a subset of the given ids).') AS prompt FROM documents GROUP BY source")
def str13_extraction_prompt(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")  # all ids of a source are its row's result
    prompt = chat.extraction_prompt(F.col("ids"), F.lit(None).cast("string"), F.lit("UNVERIFIED"), "none", F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "documents").groupBy("source").agg(ids.alias("ids")).select("source", prompt.alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 101)::DOUBLE ELSE round(0.6::DOUBLE * (o_orderkey % 101) + 0.4::DOUBLE * (o_custkey % 101), 2) END AS confidence FROM orders")
def dom06_blended_confidence(spark, d):
    det, llm = (F.col("o_orderkey") % 101).cast("double"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 101).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", chat.blended(det, llm).alias("confidence"))


@query(f"WITH {REVIEWS}, {GATED}, r AS (SELECT *, trim(review_text) AS t, {NEED_SQL} AS need FROM gated), n AS (SELECT package, arg_min((ord, t), ord) FILTER (need) AS n, arg_min((ord, t), ord) FILTER (t <> '') AS f FROM r GROUP BY package) SELECT package, coalesce(n[1], f[1]) AS ord, coalesce(n[2], f[2], '(no review text)') AS quote FROM n")
def win05_representative(spark, d):
    rows = rv.rating_gate(reviews(spark, d))
    return records.representative(rows, "package", F.col("review_text"), tx.need_bearing(F.col("review_text"), F.col("rating")))


@query("SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 12) AS twelve, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 3) AS three FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) GROUP BY source")
def win07_first_of_group(spark, d):
    ids = analysis.first_members(table(spark, d, "documents"), "source", "doc_id", 12).withColumn("ids", F.transform("ids", lambda x: x.cast("string")))
    return ids.select("source", F.array_join("ids", ",").alias("twelve"), F.array_join(F.slice("ids", 1, 3), ",").alias("three"))


_STOPS = (
    "a about after all also am an and any are as at be because been before being both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
_TOKENS = lambda text: rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{M}}\p{{N}}_][\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: NOT list_contains([{', '.join(repr(w) for w in _STOPS)}], w))"


def _word_counts(source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"""toks AS (SELECT {k}, {_TOKENS("text")} AS w FROM {source}),
grams AS (SELECT {k}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM toks), tf AS (SELECT {k}, term, count(*) AS tf FROM grams GROUP BY ALL)"""


def _weights(key: str, most: int, table_: str) -> str:
    return f"""best AS (SELECT term, count(*) AS docs, sum(tf) AS total FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {most}),
raw AS (SELECT {key}, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM {table_})) / (1 + docs)) + 1) AS w FROM tf JOIN best USING (term)),
weighed AS (SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight FROM raw)"""


@query(f"WITH {_word_counts('benchmark', 'item_id')}, {_weights('item_id', 20000, 'benchmark')} SELECT * FROM weighed")
def ml02_word_tfidf(spark, d):
    return terms.tfidf(table(spark, d, "benchmark"), "item_id", terms.word_terms(F.col("text")), 20_000)


_CHARS = f"""padded AS (SELECT item_id, ' ' || w || ' ' AS w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{WS}')) AS w FROM benchmark) WHERE w <> ''),
grams AS ({" UNION ALL ".join(f"SELECT item_id, substring(w, i, {n}) AS term FROM padded, unnest(range(1, length(w) - {n - 2})) t(i)" for n in (3, 4, 5))}), tf AS (SELECT item_id, term, count(*) AS tf FROM grams GROUP BY ALL)"""


@query(f"SELECT item_id, 'word' AS block, term, weight FROM (WITH {_word_counts('benchmark', 'item_id')}, {_weights('item_id', 12000, 'benchmark')} SELECT * FROM weighed) UNION ALL SELECT item_id, 'char', term, weight FROM (WITH {_CHARS}, {_weights('item_id', 30000, 'benchmark')} SELECT * FROM weighed)")
def ml03_union_tfidf(spark, d):
    return terms.union_tfidf(table(spark, d, "benchmark"), "item_id", "text")


@query(f"""WITH {_word_counts("documents", "source", "doc_id")}, n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), stats AS (SELECT source, term, sum(tf) AS total, count(*) AS docs FROM tf GROUP BY ALL),
known AS (SELECT s.source, term, n, ln((1.0::DOUBLE + n) / (1 + docs)) + 1 AS idf FROM (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY source ORDER BY total DESC, term) <= 500) s JOIN n USING (source)),
raw AS (SELECT t.source, t.doc_id, t.term, n, tf * idf AS w FROM tf t JOIN known USING (source, term)), norms AS (SELECT source, doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL),
mean AS (SELECT source, term, sum(w / norm) / max(n) AS score FROM raw JOIN norms USING (source, doc_id) GROUP BY ALL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term)::INTEGER AS place, term FROM mean QUALIFY place <= 8""")
def agg02_keywords(spark, d):
    return terms.keywords(table(spark, d, "documents"), "source", "doc_id", "text")


@query("WITH w AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'you', 'are', 'but', 'not', 'have', 'app', 'just'))) AS term FROM documents) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term)::INTEGER AS place, term FROM w GROUP BY lang, term QUALIFY place <= 8")
def agg02_fallback_keywords(spark, d):
    return terms.fallback_keywords(table(spark, d, "documents"), "lang", "text")


@query(f"WITH {REVIEWS}, {GATED} SELECT package, count(*) AS n FROM gated WHERE package IN ('src1', 'src2', 'src3') AND {NEED_SQL} GROUP BY package")
def ml13_control_reviews(spark, d):
    return embedding.control_reviews(rv.rating_gate(reviews(spark, d)), ("src1", "src2", "src3")).groupBy("package").agg(F.count("*").alias("n"))


@query("SELECT turn, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY turn")
def win06_user_turns(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("turn").agg(F.count("*").alias("n"))
