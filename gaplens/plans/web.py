"""Queries over pages, addresses and cached roadmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import pages, records
from gaplens.operators import reviews as rv
from gaplens.plans.registry import WS, hint, query, sentences, unique
from gaplens.sources.tables import table

_URLS = (
    "https://www.github.com/acme/app/issues", "https://github.com/other/tool", "https://old.reddit.com/r/acme", "https://www.acme.org/news",
    "https://docs.acme.com:8080/x?q=1", "https://m.facebook.com/acme", "no address at all",
)
_LINKS = "links AS (SELECT page_id, CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_URLS, 1)) + " ELSE url END AS u FROM pages)"
_HOST = "regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"


def links(spark, d):
    """Page addresses, seven in eight replaced by ones that meet the rules."""
    url = F.col("url")
    for i, u in enumerate(_URLS, 1):
        url = F.when(F.col("page_id") % 8 == i, u).otherwise(url)
    return table(spark, d, "pages").select("page_id", url.alias("u"))


_ALLOWED = (
    "'github.com', 'gitlab.com', 'bitbucket.org', 'changelog.com', 'keepachangelog.com', 'medium.com', 'dev.to', 'hashnode.dev', 'substack.com', 'wordpress.com', 'blogspot.com', 'f-droid.org', "
    "'play.google.com', 'apps.apple.com', 'en.wikipedia.org', 'reddit.com', 'www.reddit.com', 'example.com', 'acme.org', 'acme.com', 'www.acme.org', 'www.acme.com', 'forum.acme.org'"
)


@query(f"""WITH {_LINKS}, h AS (SELECT page_id, u, {_HOST} AS host, regexp_replace({_HOST}, '^www\\.', '') AS bare FROM links)
SELECT page_id, host, host <> '' AND CASE WHEN host IN ({_ALLOWED}) OR bare IN ({_ALLOWED}) THEN NOT ends_with(host, 'github.com') OR contains(lower(u), 'acme/app')
  ELSE len(list_filter([{_ALLOWED}], lambda x: ends_with(host, '.' || x) OR ends_with(bare, '.' || x))) > 0 END AS allowed FROM h""")
def fil12_host_allow(spark, d):
    return links(spark, d).select("page_id", tx.url_host(F.col("u")).alias("host"), tx.host_allowed(F.col("u"), "Acme!", "acme/App", (".Example.com",)).alias("allowed"))


@query(f"WITH {_LINKS} SELECT page_id, {_HOST} = '' OR contains({_HOST}, 'facebook.com') OR contains({_HOST}, 'instagram.com') OR contains({_HOST}, 'tiktok.com') OR contains({_HOST}, 'pinterest.com') AS denied FROM links")
def fil13_host_deny(spark, d):
    return links(spark, d).select("page_id", tx.host_denied(F.col("u")).alias("denied"))


@query("""WITH u AS (SELECT page_id, lower(CASE page_id % 7 WHEN 0 THEN 'https://www.CleanTechnica.com/x' WHEN 1 THEN 'https://podcasts.apple.com/us/podcast/saas-1' WHEN 2 THEN 'https://podcasts.apple.com/de/podcast/saas' WHEN 3 THEN 'http://a.flying-phoenix.dev' ELSE url END) AS u FROM pages)
SELECT page_id, coalesce(contains(u, 'cleantechnica.com') OR contains(u, 'cartelinsider.com') OR contains(u, 'thespinoff.co.nz') OR contains(u, 'flying-phoenix.dev') OR contains(u, 'podcasts.apple.com/us/podcast/saas'), false) AS junk FROM u""")
def fil14_junk_hosts(spark, d):
    kind = F.col("page_id") % 7
    url = F.when(kind == 0, "https://www.CleanTechnica.com/x").when(kind == 1, "https://podcasts.apple.com/us/podcast/saas-1").when(kind == 2, "https://podcasts.apple.com/de/podcast/saas").when(kind == 3, "http://a.flying-phoenix.dev").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.junk_host(url).alias("junk"))


_LEADS = (
    "You can export and sync all of your notes with the built-in widget today. ", "A dark mode is planned for the next version of this application soon. ",
    "In an interview we promised that the offline maps will launch eventually this year. ", "", "Our vision is long-term and the founders told users about it in a podcast. ", "",
)
_TEXT = rf"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{WS}', ' ', 'g'))"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_FEATURE = r"feature|supports?|you can|ability to|includes?|built[- ]in|offline|sync|export|import|dark mode|notification|widget|integration|api|share|backup|encrypt"
_PLAN = r"roadmap|coming soon|planned|we('?re| are) working|will (add|launch|introduce|ship)|upcoming|next (version|release)|on our (list|backlog)|in development|beta"
_TALK = r"interview|podcast|keynote|we announced|we promised|told (reporters|users)|in an interview|our vision|long[- ]term|eventually"
_LEAD = f"""hits AS (SELECT page_id, url, CASE WHEN page_id % 6 = 3 THEN 'Roadmap' ELSE {_TITLE} END AS title, CASE WHEN page_id % 2 = 0 THEN substring({_TEXT}, 1, 60) ELSE '' END AS body,
  [{", ".join(f"'{x}'" for x in _LEADS)}][page_id % 6 + 1] || {_TEXT} AS page FROM pages)"""


def _classified(page: str = "page", most: str = "", bullet: str = "title || ': ' || body", each: str = "") -> str:
    """The parts of SQL that classify hits: whole, or with the given cuts."""
    return f"""blobs AS (SELECT *, concat_ws(chr(10), title, body, {page}) AS blob FROM hits),
parts AS (SELECT *, {sentences("blob", 40, 280)}{most} AS s, CASE WHEN {hint("blob", _PLAN)} OR contains(lower(title), 'roadmap') THEN 'planned' WHEN {hint("blob", _TALK)} THEN 'interview_signal' WHEN {hint("blob", _FEATURE)} OR contains(lower(title), 'feature') THEN 'current_feature' ELSE 'other' END AS kind FROM blobs),
lists AS (SELECT *, list_filter(s, lambda x: {hint("x", _PLAN)}) AS p, list_filter(s, lambda x: {hint("x", _PLAN)} AND ({hint("blob", _TALK)} OR {hint("x", _TALK)})) AS q, list_filter(s, lambda x: NOT {hint("x", _PLAN)} AND {hint("x", _FEATURE)}) AS c FROM parts),
thin AS (SELECT *, len(c) = 0 AND len(p) = 0 AND body <> '' AS thin, [{bullet}] AS bullet FROM lists),
taken AS (SELECT *, CASE WHEN thin AND kind NOT IN ('planned', 'interview_signal') THEN bullet WHEN thin THEN [] ELSE c END AS c1, CASE WHEN thin AND kind = 'planned' THEN bullet WHEN thin THEN [] ELSE p END AS p1, CASE WHEN thin AND kind = 'interview_signal' THEN bullet WHEN thin THEN [] ELSE q END AS q1 FROM thin),
classified AS (SELECT page_id, url, title, body, page, kind, {unique("c1")}{each} AS current, {unique("p1")}{each} AS planned, {unique("q1")}{each} AS promised FROM taken)"""


_HITS = f"""{_LEAD},
{_classified("substring(page, 1, 2500)", "[1:40]", "substring(title || ': ' || body, 1, 240)", "[1:8]")}"""


def hits(spark, d):
    """Pages as search hits: some led by a sentence of a known kind."""
    k = F.col("page_id") % 6
    text = tx.html_text(F.col("html"))
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (k + 1).cast("int"))
    title = F.when(k == 3, "Roadmap").otherwise(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", "url", title.alias("title"), F.when(F.col("page_id") % 2 == 0, F.substring(text, 1, 60)).otherwise("").alias("body"), F.concat(lead, text).alias("page"))


@query(f"WITH {_LEAD},\n{_classified()} SELECT page_id, kind, array_to_string(current, '|') AS current, array_to_string(planned, '|') AS planned, array_to_string(promised, '|') AS promised FROM classified")
def str09_page_kind(spark, d):
    found = hits(spark, d).select("page_id", pages.classified(F.col("title"), F.col("body"), F.col("page")).alias("c"))
    return found.select("page_id", F.col("c.kind").alias("kind"), *[F.array_join(f"c.{x}", "|").alias(x) for x in ("current", "planned", "promised")])


_STRICT = "(contains({b}, 'the and') OR (contains({b}, 'the') AND contains({b}, 'and')))"


@query(f"""WITH {_HITS}, near AS (SELECT *, page_id % 20 AS product FROM classified WHERE NOT contains(lower(url), 'facebook') AND {_STRICT.format(b="lower(concat_ws(' ', title, body, url))")}),
firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY product, trim(url) ORDER BY page_id) = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY page_id, trim(url)) AS place FROM firsts QUALIFY place <= 12),
kept AS (SELECT * FROM picked WHERE {_STRICT.format(b="lower(concat_ws(' ', title, substring(page, 1, 1500), url))")}),
joined AS (SELECT product, count(*) AS sources, flatten(list(current ORDER BY place)) AS c, flatten(list(planned ORDER BY place)) AS p, flatten(list(promised ORDER BY place)) AS q FROM kept GROUP BY product)
SELECT product::BIGINT AS product, sources, len({unique("c")}[1:25])::INTEGER AS current, len({unique("p")}[1:25])::INTEGER AS planned, len({unique("q")}[1:25])::INTEGER AS promised, CASE product % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'web' ELSE 'hybrid' END AS source FROM joined""")
def src22_web_roadmap(spark, d):
    rows = hits(spark, d).withColumn("product", F.col("page_id") % 20).withColumn("ord", F.col("page_id"))
    found = pages.web_roadmap(rows, "product", "The And")
    before = F.when(F.col("product") % 3 == 0, "github").when(F.col("product") % 3 == 1, "none").otherwise("hybrid")
    return found.select("product", "sources", *[F.size(c).alias(c) for c in ("current", "planned", "promised")], pages.merged_source(before, F.col("sources")).alias("source"))


_BARE = r"regexp_replace(html, '(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g')"
_PLAIN = lambda part: rf"trim(regexp_replace(regexp_replace({part}, '(?s)<[^>]*>', ' ', 'g'), '{WS}', ' ', 'g'))"
_SAYS = lambda text: f"(contains(lower(concat_ws(' ', title, {text}, url)), 'the or') OR (contains(lower(concat_ws(' ', title, {text}, url)), 'the')))"


@query(rf"""WITH p AS (SELECT page_id, url, {_TITLE} AS title, {_BARE} AS bare FROM pages),
s AS (SELECT *, regexp_extract_all(bare, '(?is)<(?:article|main|section)\b[^>]*>(.*?)</(?:article|main|section)\s*>', 1) AS found FROM p),
t AS (SELECT *, list_transform(CASE WHEN len(found) > 0 THEN found ELSE [bare] END, lambda x: {_PLAIN("x")}) AS sections, {_PLAIN("bare")} AS whole FROM s),
k AS (SELECT *, flatten(list_transform(sections, lambda x: CASE WHEN x <> '' AND {_SAYS("x")} THEN list_filter({sentences("x", 40, 320)}, lambda y: {_SAYS("y")}) ELSE [] END)) AS kept FROM t),
f AS (SELECT *, CASE WHEN {_SAYS("whole")} AND contains(lower(title), 'the or') THEN list_filter({sentences("whole", 40, 320)}, lambda y: {_SAYS("y")} AND (contains(lower(y), 'the') OR {hint("y", _PLAN + "|milestone")})) ELSE [] END AS rest FROM k)
SELECT page_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE rest END, ' ') AS text FROM f WHERE len(kept) > 0 OR len(rest) > 0""")
def fil26_relevant_text(spark, d):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = table(spark, d, "pages").select("page_id", pages.relevant_text(F.col("html"), title, F.col("url"), "The Or").alias("text"))
    return found.where("text is not null")


@query("""WITH u AS (SELECT page_id % 25 AS product, page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/topics/notes' WHEN 1 THEN 'https://github.com/other/thing-' || page_id % 3 WHEN 2 THEN 'https://GitHub.com/maker/fine-notes/issues?q=1' WHEN 3 THEN url ELSE 'http://github.com/fine/x_' || page_id % 2 END AS u FROM pages),
c AS (SELECT *, regexp_extract(u, '(?i)github\\.com/([^/]+)/([^/#?\\s]+)', 1) AS o, regexp_extract(u, '(?i)github\\.com/([^/]+)/([^/#?\\s]+)', 2) AS r FROM u),
f AS (SELECT *, translate(lower(o || ' ' || r), '-_', '  ') AS b FROM c WHERE o <> '' AND lower(o) NOT IN ('topics', 'search', 'orgs', 'settings')),
g AS (SELECT product, page_id, o || '/' || r AS repo, contains(b, 'fine') OR contains(b, 'notes') OR contains(replace(b, ' ', ''), 'finenotes') AS fits FROM f),
l AS (SELECT product, list(repo ORDER BY page_id) FILTER (fits) AS repos FROM g GROUP BY product)
SELECT p.product, coalesce(list_reduce(repos, lambda a, x: CASE WHEN contains(lower(a), 'fine') OR contains(lower(a), 'notes') THEN a ELSE x END), '') AS repo FROM (SELECT DISTINCT product FROM u) p LEFT JOIN l USING (product)""")
def str10_repo_from_urls(spark, d):
    i = F.col("page_id")
    url = F.when(i % 5 == 0, "https://github.com/topics/notes").when(i % 5 == 1, F.concat(F.lit("https://github.com/other/thing-"), (i % 3).cast("string"))).when(i % 5 == 2, "https://GitHub.com/maker/fine-notes/issues?q=1").when(i % 5 == 3, F.col("url")).otherwise(F.concat(F.lit("http://github.com/fine/x_"), (i % 2).cast("string")))
    listed = table(spark, d, "pages").groupBy((i % 25).alias("product")).agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), url.alias("u")))).alias("l"))  # a product's search hits
    return listed.select("product", pages.discovered_repo(F.col("l.u"), "Fine Notes").alias("repo"))


def caches(spark, d):
    """Documents as cached roadmaps: one for each ten, lists by the last digit of the id."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("app"), (F.col("doc_id") % 10).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("k").isin(*kinds), F.struct("doc_id", "text")))), lambda x: x["text"])
    e = F.struct("doc_id", F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 900).alias("snippet"), F.when(F.col("k") == 6, "https://cleantechnica.com/a").otherwise("https://a.example/b").alias("url"), F.when(F.col("doc_id") % 3 == 0, "current_feature").when(F.col("doc_id") % 3 == 1, "planned").alias("kind"))
    evidence = F.array_sort(F.collect_list(F.when(F.col("k").isin(5, 6, 7), e)))  # ten rows a group
    return docs.groupBy("app").agg(texts(0, 1).alias("planned_items"), texts(2, 3, 4).alias("promised_unshipped"), evidence.alias("evidence"), texts(8, 9, 0).alias("current_features"))


_CACHE = rf"""docs AS (SELECT doc_id // 10 AS app, doc_id % 10 AS k, doc_id, coalesce(text, '') AS t FROM documents),
planned AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY doc_id) - 1 AS pos FROM docs WHERE k IN (0, 1)),
promised AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY doc_id) - 1 AS pos FROM docs WHERE k IN (2, 3, 4)),
features AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY doc_id) - 1 AS pos FROM docs WHERE k IN (8, 9, 0)),
evidence AS (SELECT *, trim(substring(t, 1, 40) || '. ' || substring(t, 41, 900)) AS blob, CASE doc_id % 3 WHEN 0 THEN 'current_feature' WHEN 1 THEN 'planned' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY app ORDER BY doc_id) - 1 AS pos FROM docs WHERE k IN (5, 6, 7)),
rows_ AS (SELECT app, 0 AS part, pos, 'cache-planned-' || pos AS item_id, t AS text, 'open' AS state, 'planned' AS kind, NULL AS closed_at FROM planned WHERE contains(lower(t), 'the')
  UNION ALL SELECT app, 1, pos, 'cache-promised-' || pos, t, 'open', 'promised', NULL FROM promised WHERE contains(lower(t), 'the')
  UNION ALL SELECT app, 2, pos, 'e' || doc_id, substring(blob, 1, 800), CASE WHEN kind = 'current_feature' THEN 'closed' ELSE 'open' END, kind, NULL FROM evidence WHERE contains(lower(blob), 'the') AND k <> 6
  UNION ALL SELECT app, 3, pos, 'cache-feature-' || pos, substring(t, 1, 800), 'closed', 'current_feature', '2020-01-01T00:00:00Z' FROM features WHERE contains(lower(t), 'the') AND length(t) >= 40 AND length(t) - length(replace(t, '-', '')) <= 12),
firsts AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY app, substring(regexp_replace(lower(text), '{WS}', ' ', 'g'), 1, 200) ORDER BY part, pos) = 1)"""


@query(f"WITH {_CACHE} SELECT app, item_id, text, state, kind, closed_at FROM firsts")
def src13_roadmap_cache(spark, d):
    return pages.cached_roadmap(caches(spark, d), "app", "The").select("app", "item_id", "text", "state", "kind", "closed_at")


@query(f"WITH {_CACHE} SELECT a.app, count(f.app) AS items, CASE WHEN count(f.app) = 0 THEN 'none' WHEN a.app % 2 = 0 THEN 'github' ELSE 'web' END AS source FROM (SELECT DISTINCT app FROM docs) a LEFT JOIN firsts f USING (app) GROUP BY a.app")
def dom08_cache_source(spark, d):
    every = caches(spark, d)
    n = pages.cached_roadmap(every, "app", "The").groupBy("app").agg(F.count("*").alias("n"))
    items = F.coalesce("n", F.lit(0))
    return every.select("app").join(n, "app", "left").select("app", items.alias("items"), pages.cache_source(F.when(F.col("app") % 2 == 0, "github").otherwise("none"), items).alias("source"))


_SHIPPED = hint(f"({_TITLE} || {_TEXT})", "changelog|released?|shipped")


@query(f"SELECT 'web-' || page_id AS item_id, substring({_TITLE} || '. ' || {_TEXT}, 1, 1000) AS text, CASE WHEN {_SHIPPED} THEN 'closed' ELSE 'open' END AS state, CASE WHEN {_SHIPPED} THEN '2020-01-01' END AS closed FROM pages WHERE {_TEXT} <> ''")
def src16_page_items(spark, d):
    found = records.page_items(table(spark, d, "pages"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), tx.html_text(F.col("html")))
    return found.select("item_id", F.col("item_text").alias("text"), "state", F.date_format("closed_at", "yyyy-MM-dd").alias("closed"))


_PASTE = r"""blobs AS (SELECT doc_id AS ord, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM documents),
chunks AS (SELECT ord, list_filter(list_transform(CASE WHEN contains(b, chr(10) || chr(10)) THEN regexp_split_to_array(b, '\n\s*\n') ELSE string_split(b, chr(10)) END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM blobs),
pasted AS (SELECT ord, 'paste-' || (i - 1) AS item_id, substring(c[i], 1, 1000) AS text FROM chunks, unnest(range(1, len(c) + 1)) t(i) WHERE length(c[i]) >= 8)"""


def _pasted(spark, d):
    k = F.col("doc_id") % 4 == 0  # some with an empty line after every line
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.when(k, F.replace(text, F.lit("\n"), F.lit("\n \n\n"))).otherwise(text).alias("review_text"))


@query(f"WITH {_PASTE.replace('coalesce(text, ' + chr(39) * 2 + ')', 'CASE WHEN doc_id % 4 = 0 THEN replace(coalesce(text, ' + chr(39) * 2 + '), chr(10), chr(10) || chr(32) || chr(10) || chr(10)) ELSE coalesce(text, ' + chr(39) * 2 + ') END')} SELECT ord, item_id, text FROM pasted")
def src14_paste_items(spark, d):
    return rv.paste_items(_pasted(spark, d))


@query(f"WITH {_PASTE} SELECT 'web-' || page_id AS item_id, substring({_TITLE} || '. ' || {_TEXT}, 1, 1000) AS text, CASE WHEN {_SHIPPED} THEN 'closed' ELSE 'open' END AS state, 'web_page' AS kind FROM pages WHERE {_TEXT} <> '' UNION ALL SELECT item_id, text, 'open', 'planned' FROM pasted")
def src17_external_roadmap(spark, d):
    found = records.page_items(table(spark, d, "pages"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), tx.html_text(F.col("html")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("review_text"))
    return pages.external_items(found, rv.paste_items(docs))


@query("SELECT p_partkey, contains(t, 'red blue') OR (contains(t, 'red') AND contains(t, 'blue')) AS mentioned, contains(t, 'red') AS loose, contains(t, 'red') AS strict FROM (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type)) AS t FROM part)")
def fil10_product_mention(spark, d):
    blob = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", records.mentions_product(blob, "Red Blue").alias("mentioned"), records.mentions_product(blob, "Red").alias("loose"), records.mentions_product(blob, "Red", strict=True).alias("strict"))
