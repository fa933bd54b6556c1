"""Queries over apps, jobs, catalogs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import records, store, tables
from gaplens.operators import reviews as rv
from gaplens.plans.registry import query
from gaplens.sources import tables as src
from gaplens.sources.tables import table

_APPS = """apps AS (SELECT c_custkey AS id, 'com.acme.app' || c_custkey AS package_name, c_name AS display_name, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 977)::INTEGER END AS review_count,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50) / 10.0 END::DOUBLE AS avg_stars, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'acme/' || c_custkey END AS github_repo,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'web' END AS roadmap_source, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE (c_custkey % 11)::INTEGER END AS roadmap_item_count,
  CASE WHEN c_custkey % 6 < 3 THEN '{"roadmap_item_count": ' || c_custkey % 13 || '}' ELSE '{}' END AS metadata, CASE WHEN c_custkey % 8 <> 0 THEN 'Fine.' END AS sample_review, '' AS dataset, '' AS app_name FROM customer)"""


def apps(spark, d):
    """Customers as stored apps with gaps in most fields."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.concat(F.lit("com.acme.app"), k.cast("string")).alias("package_name"), F.col("c_name").alias("display_name"),
        F.when(k % 5 != 0, (k % 977).cast("int")).alias("review_count"), F.when(k % 7 != 0, (k % 50) / 10.0).cast("double").alias("avg_stars"),
        F.when(k % 3 == 1, " ").when(k % 3 == 2, F.concat(F.lit("acme/"), k.cast("string"))).alias("github_repo"), F.when(k % 4 == 0, "").when(k % 4 > 1, "web").alias("roadmap_source"),
        F.when(k % 2 != 0, (k % 11).cast("int")).alias("roadmap_item_count"), F.when(k % 6 < 3, F.concat(F.lit('{"roadmap_item_count": '), (k % 13).cast("string"), F.lit("}"))).otherwise("{}").alias("metadata"),
        F.when(k % 8 != 0, "Fine.").alias("sample_review"), F.lit("").alias("dataset"), F.lit("").alias("app_name"),
    )


_NORMAL = "normal AS (SELECT id, package_name, display_name, coalesce(review_count, 0) AS review_count, avg_stars, github_repo, coalesce(nullif(roadmap_source, ''), 'none') AS roadmap_source, coalesce(roadmap_item_count, CAST(json_extract_string(metadata, '$.roadmap_item_count') AS INTEGER), 0) AS roadmap_item_count, sample_review, 'sealuzh/app_reviews' AS dataset FROM apps)"


@query(f"WITH {_APPS}, {_NORMAL} SELECT * EXCLUDE (dataset) FROM normal")
def prj01_public_app(spark, d):
    return store.public_app(apps(spark, d))


@query(f"WITH {_APPS}, {_NORMAL} SELECT * FROM normal")
def prj02_normalised_app(spark, d):
    return store.normalised_app(apps(spark, d))


_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS app_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'embedding' END AS stage,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100)::INTEGER END AS progress, CASE WHEN o_orderkey % 4 < 2 THEN 'github' ELSE '' END AS roadmap_source,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"total_reviews": ' || o_orderkey % 500 || ', "clusters": 7, "llm_used": true, "elapsed_s": 4.5}' WHEN 2 THEN '{"reviews_total": ' || o_orderkey % 300 || ', "total_reviews": 5, "embedding_backend": "tfidf", "llm_used": false}' ELSE '{}' END AS stats FROM orders)"""


def jobs(spark, d):
    """Orders as jobs; a third of them with statistics of either kind."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    first = F.concat(F.lit('{"total_reviews": '), text(k % 500), F.lit(', "clusters": 7, "llm_used": true, "elapsed_s": 4.5}'))
    second = F.concat(F.lit('{"reviews_total": '), text(k % 300), F.lit(', "total_reviews": 5, "embedding_backend": "tfidf", "llm_used": false}'))
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("app_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "embedding").alias("stage"), F.when(k % 2 == 0, (k % 100).cast("int")).alias("progress"), F.when(k % 4 < 2, "github").otherwise("").alias("roadmap_source"),
        F.when(k % 4 == 1, first).when(k % 4 == 2, second).when(k % 4 == 3, "{}").alias("stats"),
    )


@query(f"""WITH {_JOBS}, s AS (SELECT *, stats::JSON AS j FROM jobs) SELECT id, status, coalesce(nullif(stage, ''), 'queued') AS stage, coalesce(progress, 0) AS progress, coalesce(nullif(roadmap_source, ''), 'none') AS roadmap_source,
  coalesce((j->>'$.total_reviews')::INTEGER, 0) AS total_reviews, coalesce((j->>'$.clusters')::INTEGER, 0) AS clusters, 0 AS roadmap_items, coalesce((j->>'$.llm_used')::BOOLEAN, false) AS llm_used, coalesce(j->>'$.embedding_backend', '') AS embedding_backend,
  coalesce((j->>'$.elapsed_s')::DOUBLE, 0.0::DOUBLE) AS elapsed_s, 'parquet_cache' AS review_provenance, coalesce((j->>'$.reviews_total')::INTEGER, (j->>'$.total_reviews')::INTEGER, 0) AS reviews_total, 0 AS reviews_need_bearing FROM s""")
def prj03_job_view(spark, d):
    return store.job_view(jobs(spark, d))


@query(f"""WITH {_APPS} SELECT 'id' AS found_by, id FROM apps WHERE id = 42 UNION ALL SELECT 'package', min(c_custkey) FROM customer WHERE lower(c_mktsegment) = 'building' HAVING count(*) > 0""")
def fil29_point_lookup(spark, d):
    by_id = store.point_lookup(apps(spark, d), "id", 42, "id").select(F.lit("id").alias("found_by"), "id")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("package_name"))
    return by_id.unionByName(store.point_lookup(rows, "package_name", "building", "id").select(F.lit("package").alias("found_by"), "id"))


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS gap_id, string_agg(x, '+' ORDER BY x) AS shown FROM lineitem, unnest(['p' || l_partkey, 's' || l_suppkey]) t(x) WHERE l_linenumber % 2 = 1 GROUP BY ALL),
g AS (SELECT l_orderkey AS job_id, string_agg(l_linenumber || ':' || l_returnflag || ':' || coalesce(shown, ''), ';' ORDER BY l_linenumber, l_returnflag) AS gaps FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) l LEFT JOIN e ON e.gap_id = l_orderkey * 10 + l_linenumber GROUP BY l_orderkey)
SELECT o_orderkey AS job_id, c_name AS app, coalesce(gaps, '') AS gaps FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = o_custkey LEFT JOIN g ON g.job_id = o_orderkey""")
def joi06_nested_jobs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gap_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("verdict"), "l_partkey", "l_suppkey")
    kinds = F.explode(F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))))
    evidence = lines.where("rank % 2 = 1").select("gap_id", kinds.alias("evidence_id"), F.lit("review").alias("source_type"))
    gaps = lines.select("job_id", "gap_id", "rank", "verdict").distinct()
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("app_id"))
    customers = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("app"))
    nested = store.nested_jobs(rows, customers, gaps, evidence)
    shown = F.transform("gaps", lambda g: F.concat_ws(":", g["rank"].cast("string"), g["verdict"], F.array_join(F.transform(g["evidence"], lambda e: e["evidence_id"]), "+")))
    return nested.select("job_id", "app", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("gaps"))


_INVENTORY = """inventory AS (SELECT p_partkey AS pos, 'org.p' || p_partkey || '.' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || p_size AS package_name, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE ' ' END AS app_name,
  CASE WHEN p_partkey % 9 = 0 THEN 'many' ELSE (p_partkey * 37 % 1000)::VARCHAR END AS reviews, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE (p_partkey % 50 / 10.0)::DECIMAL(3,1)::VARCHAR END AS avg_stars, '' AS dataset, CASE WHEN p_partkey % 3 = 0 THEN ' own/' || p_partkey ELSE ' ' END AS github_repo FROM part),
known AS (SELECT package_name, 'known/' || pos AS known FROM inventory WHERE pos % 4 = 0),
rebuilt AS (SELECT package_name, CASE WHEN trim(app_name) <> '' THEN trim(app_name) ELSE array_to_string(list_transform(regexp_extract_all(regexp_extract(package_name, '([^.]*)$', 1), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: upper(w[1]) || w[2:]), ' ') END AS display_name,
  coalesce(try_cast(reviews AS INTEGER), 0) AS reviews, try_cast(avg_stars AS DOUBLE) AS avg_stars, 'sealuzh/app_reviews' AS dataset, coalesce(nullif(trim(github_repo), ''), known) AS github_repo FROM inventory LEFT JOIN known USING (package_name))"""


def inventory(spark, d):
    """Parts as an inventory of packages, all columns texts."""
    k = F.col("p_partkey")
    tail = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(
        k.alias("pos"), F.concat(F.lit("org.p"), k.cast("string"), F.lit("."), tail).alias("package_name"), F.when(k % 5 == 0, F.col("p_name")).otherwise(" ").alias("app_name"),
        F.when(k % 9 == 0, "many").otherwise((k * 37 % 1000).cast("string")).alias("reviews"), F.when(k % 4 == 0, "").otherwise((k % 50 / 10.0).cast("decimal(3,1)").cast("string")).alias("avg_stars"),
        F.lit("").alias("dataset"), F.when(k % 3 == 0, F.concat(F.lit(" own/"), k.cast("string"))).otherwise(" ").alias("github_repo"),
    )


def known(spark, d):
    return inventory(spark, d).where("pos % 4 = 0").select("package_name", F.concat(F.lit("known/"), F.col("pos").cast("string")).alias("github_repo"))


@query(f"WITH {_INVENTORY} SELECT *, CASE WHEN github_repo IS NOT NULL THEN 'github' ELSE 'none' END AS roadmap_source, github_repo IS NOT NULL AS likely_applicable FROM rebuilt")
def src19_catalog_rebuild(spark, d):
    return store.rebuilt_catalog(inventory(spark, d), known(spark, d))


@query(f"WITH {_INVENTORY} SELECT package_name, github_repo FROM rebuilt")
def joi08_known_repos(spark, d):
    return store.known_repos(inventory(spark, d).select("package_name", "github_repo"), known(spark, d))


@query(f"WITH {_INVENTORY} SELECT count(*) AS apps, count(github_repo) AS with_repo, count(*) - count(github_repo) AS without_repo FROM rebuilt")
def agg25_catalog_counts(spark, d):
    rows = store.rebuilt_catalog(inventory(spark, d), known(spark, d))
    return rows.agg(F.count("*").alias("apps"), F.count("github_repo").alias("with_repo"), F.count_if(F.col("github_repo").isNull()).alias("without_repo"))


@query(f"WITH {_INVENTORY} SELECT package_name, reviews FROM rebuilt WHERE reviews >= 50 AND github_repo IS NOT NULL ORDER BY reviews DESC, package_name LIMIT 50")
def fil23_listed(spark, d):
    return store.listed(store.rebuilt_catalog(inventory(spark, d), known(spark, d)), only_repo=True).select("package_name", "reviews")


@query(f"WITH {_INVENTORY}, t AS (SELECT * FROM rebuilt WHERE reviews >= 50 ORDER BY reviews DESC, package_name LIMIT 50) SELECT lpad((row_number() OVER (ORDER BY reviews DESC, package_name))::VARCHAR, 3, ' ') || '  ' || lpad(reviews::VARCHAR, 8, ' ') || '  ' || lpad(coalesce(avg_stars, 0.0)::VARCHAR, 5, ' ') || '  ' || rpad(coalesce(github_repo, '-'), 42, ' ') || '  ' || substring(display_name, 1, 46) AS line FROM t")
def prj07_console_lines(spark, d):
    from pyspark.sql import Window

    rows = store.listed(store.rebuilt_catalog(inventory(spark, d), known(spark, d)))
    place = F.row_number().over(Window.orderBy(F.desc("reviews"), "package_name"))
    return rows.select(store.console_line(place, F.col("reviews"), F.coalesce("avg_stars", F.lit(0.0)), F.col("github_repo"), F.col("display_name")).alias("line"))


@query("SELECT source AS package, count(*) AS reviews FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10")
def srt07_packages_by_reviews(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("package")).agg(F.count("*").alias("reviews")).orderBy(F.desc("reviews"), "package").limit(10)


@query("SELECT p_partkey::VARCHAR AS app_id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR ELSE p_name END AS app_name, coalesce(n, 0) AS reviews, coalesce(s, 0.0) AS avg_stars FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, round(avg(l_linenumber), 4) AS s FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL) ON l_partkey = p_partkey")
def joi09_review_counts(spark, d):
    info = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("app_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"))
    counts = table(spark, d, "lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").cast("string").alias("app_id")).agg(F.count("*").alias("n"), F.round(F.avg("l_linenumber"), 4).alias("s"))
    return info.join(counts, "app_id", "left").select("app_id", F.coalesce("name", "app_id").alias("app_name"), F.coalesce("n", F.lit(0)).alias("reviews"), F.coalesce("s", F.lit(0.0)).alias("avg_stars"))


@query("SELECT c_custkey, n_name AS repo, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey * 100 END AS stars, n_nationkey % 2 = 0 AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey")
def joi10_cached_stats(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("repo")), F.col("c_nationkey") == F.col("n_nationkey"))
    cached = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("repo"), (F.col("n_regionkey") * 100).alias("stars"))
    return rows.join(cached, "repo", "left").select("c_custkey", "repo", "stars", F.col("stars").isNotNull().alias("ok"))


@query(f"""WITH {_APPS}, c AS (SELECT 'com.acme.app' || (o_custkey) AS package_name, arg_min((o_orderkey % 1000)::INTEGER, o_orderkey) AS reviews, arg_min(round(o_totalprice / 100000, 2), o_orderkey) AS s FROM orders GROUP BY ALL)
SELECT a.package_name, CASE WHEN id % 2 = 0 THEN review_count ELSE coalesce(reviews, 0) END AS review_count, CASE WHEN id % 2 = 0 THEN avg_stars ELSE s END AS avg_stars FROM apps a LEFT JOIN c USING (package_name)""")
def joi11_catalog_fallback(spark, d):
    every = apps(spark, d)
    rows = table(spark, d, "orders").select(F.concat(F.lit("com.acme.app"), F.col("o_custkey").cast("string")).alias("package_name"), (F.col("o_orderkey") % 1000).cast("int").alias("reviews"), F.round(F.col("o_totalprice") / 100000, 2).alias("avg_stars"), F.col("o_orderkey").alias("pos"))
    return store.catalog_fallback(every.select("package_name"), every.where("id % 2 = 0"), rows)


@query(f"WITH {_APPS} SELECT package_name, nullif(trim(github_repo), '') AS github_repo, coalesce(nullif(roadmap_source, ''), CASE WHEN trim(github_repo) <> '' THEN 'github' ELSE 'none' END) AS roadmap_source, CASE WHEN id % 4 <> 0 THEN 'Known ' || id ELSE 'App' || id END AS display_name FROM apps")
def src18_catalog(spark, d):
    rows = apps(spark, d).withColumn("display_name", F.lit(""))
    names = apps(spark, d).where("id % 4 <> 0").select("package_name", F.concat(F.lit("Known "), F.col("id").cast("string")).alias("name"))
    return store.catalog(rows, names).select("package_name", "github_repo", "roadmap_source", "display_name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Loop Habit Tracker' WHEN p_partkey % 10 = 1 THEN 'org.' ELSE upper(substring(tail, 1, 1)) || substring(tail, 2) END AS shown, tail AS package FROM (SELECT p_partkey, replace(p_name, ' ', '') AS tail FROM part)")
def str07_display_name(spark, d):
    tail = F.replace("p_name", F.lit(" "), F.lit(""))
    package = F.when(F.col("p_partkey") % 10 == 0, "org.isoron.UHabits").when(F.col("p_partkey") % 10 == 1, "org.").otherwise(F.concat(F.lit("org.acme."), tail))
    return table(spark, d, "part").select("p_partkey", tx.display_name(package).alias("shown"), tail.alias("package"))


_EXACT = [("small ring", "exact/ring"), ("red widget", "exact/widget")]
_WORDS = [("almond", "nuts/almond"), ("blue", "colours/blue"), ("red", "colours/red"), ("a", "letters/a")]


@query("SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 'exact/ring' WHEN p_name = 'red widget' THEN 'exact/widget' WHEN contains(lower(p_name), 'almond') THEN 'nuts/almond' WHEN contains(lower(p_name), 'blue') THEN 'colours/blue' WHEN contains(lower(p_name), 'red') THEN 'colours/red' WHEN contains(lower(p_name), 'a') THEN 'letters/a' END AS repo FROM part")
def joi07_priority_map(spark, d):
    return tables.mapped(table(spark, d, "part"), "p_name", _EXACT, _WORDS).select("p_partkey", F.col("hit").alias("repo"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def fil16_catalog_search(spark, d):
    return rv.catalog_search(table(spark, d, "part"), ["p_name", "p_type"], " RED ", [F.desc("p_retailprice"), F.asc("p_partkey")], 20).select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 25")
def ui07_search_all(spark, d):
    return rv.catalog_search(table(spark, d, "supplier"), ["s_name"], "  ", [F.asc("s_suppkey")], 25).select("s_suppkey", "s_name")


@query("SELECT event_id, array_to_string(list_sort(['extra=' || event_type, 'k=' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END]), ',') AS merged, 'k=' || json_extract_string(props, '$.k') AS subset FROM events")
def map01_merge(spark, d):
    old = F.from_json("props", "map<string,string>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new"), F.lit("extra"), F.col("event_type"))).otherwise(F.create_map(F.lit("extra"), F.col("event_type")))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "events").select("event_id", shown(store.merged_metadata(old, new)).alias("merged"), shown(store.metric_subset(old, ("k", "none"))).alias("subset"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def hsh05_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))


@query("SELECT n_regionkey, substring(sha1(string_agg(n_name || chr(0), '' ORDER BY n_nationkey)), 1, 16) AS hash FROM nation GROUP BY ALL")
def hsh02_roadmap_hash(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))  # a roadmap has a bounded list of items
    texts = F.transform(listed, lambda x: F.concat(x["n_name"], F.lit("\0")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.substring(F.sha1(F.array_join(texts, "")), 1, 16).alias("hash"))


@query("SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS llm_used FROM orders GROUP BY ALL")
def agg20_any_llm(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("llm_used"))


@query("SELECT doc_id // 10 AS product_id, count(*) FILTER (doc_id % 10 IN (0, 8, 9))::INTEGER AS current_features_n, count(*) FILTER (doc_id % 10 < 2)::INTEGER AS planned_items_n, count(*) FILTER (doc_id % 10 BETWEEN 2 AND 4)::INTEGER AS promised_unshipped_n, count(*) FILTER (doc_id % 10 BETWEEN 5 AND 7)::INTEGER AS evidence_n, 'none' AS roadmap_source, 'a note' AS notes FROM documents GROUP BY ALL")
def prj06_context_summary(spark, d):
    from gaplens.plans.web import caches

    rows = caches(spark, d).select(F.col("app").alias("product_id"), F.lit("x").alias("display_name"), F.lit("none").alias("roadmap_source"), "planned_items", "promised_unshipped", "evidence", "current_features", F.lit(" a note ").alias("notes"))
    return store.context_summary(rows).drop("display_name")


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'p' || c_custkey % 1000 END AS package_name, c_custkey % 101 - 1 AS review_count FROM customer), v AS (SELECT * FROM r WHERE package_name IS NOT NULL AND review_count >= 0)
SELECT id, package_name, review_count FROM v QUALIFY id = min(id) OVER (PARTITION BY package_name)""")
def ddl01_valid_apps(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 50 != 0, F.concat(F.lit("p"), (k % 1000).cast("string"))).alias("package_name"), (k % 101 - 1).alias("review_count"))
    return store.valid_apps(rows).select("id", "package_name", "review_count")


@query("SELECT doc_id::VARCHAR AS review_id, text AS review_text, NULL::DOUBLE AS rating, NULL::VARCHAR AS created_at FROM documents ORDER BY doc_id LIMIT 100")
def src02_conform(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ORD"), F.col("doc_id").alias("Review_ID"), F.col("text").alias("REVIEW_TEXT"))
    return src.conform(rows, 100)


@query("SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def set06_difference(spark, d):
    old = table(spark, d, "nation").where("n_regionkey <> 1")
    return tables.without(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), old, "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("suppliers"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS by_update, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS by_weight FROM orders) SELECT o_custkey, o_orderkey, by_update::INTEGER AS by_update, by_weight::INTEGER AS by_weight FROM o WHERE by_update <= 3 OR by_weight <= 3")
def srt09_issue_order(spark, d):
    return records.first_by(table(spark, d, "orders"), "o_custkey", {"by_update": [F.desc("o_orderdate"), F.asc("o_orderkey")], "by_weight": [F.desc("o_totalprice"), F.asc("o_orderkey")]}, 3).select("o_custkey", "o_orderkey", "by_update", "by_weight")


@query("SELECT doc_id, array_to_string(l[1:8], '|') AS eight, array_to_string(l[1:12], '|') AS twelve, len(l[1:25])::INTEGER AS n25, len(l[1:40])::INTEGER AS n40 FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ ]+') AS l FROM documents)")
def srt08_list_caps(spark, d):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(words, 1, 8), "|").alias("eight"), F.array_join(F.slice(words, 1, 12), "|").alias("twelve"), F.size(F.slice(words, 1, 25)).alias("n25"), F.size(F.slice(words, 1, 40)).alias("n40"))
