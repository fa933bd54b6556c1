"""Operators and sources that no query shows: caches, uploads, trackers, stores, spaces, chat."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaplens.functions import text as tx
from gaplens.operators import chat, embedding, matching, pages, store
from gaplens.sources import issues, sinks, tables

LONG = "I wish it had a way to sort all of the shows by hand"


def test_fetch_falls_back(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = spark.createDataFrame([("1", LONG, 2.0, "2016-01-01")], tables.REVIEW_SCHEMA)

    def fails(_):
        raise OSError("gone")

    assert tables.fetch_reviews(spark, "a", cache, fails)[1:] == (["remote reviews failed: OSError", "no reviews of a"], "parquet_cache")
    got, notes, origin = tables.fetch_reviews(spark, "a", cache, lambda p: rows)
    assert (got.count(), notes, origin) == (1, [], "hf")
    got, notes, origin = tables.fetch_reviews(spark, "a", cache, fails, refresh=True)
    assert (got.count(), notes, origin) == (1, ["remote reviews failed: OSError"], "hf")
    assert sinks.prefetch(spark, ["a", "b"], cache, lambda p: rows.limit(0)) == {"a": 1, "b": 0}
    assert tables.empty(spark, "issues").count() == 0 and "due_on" in tables.empty(spark, "issues").columns


def test_remote_rows_and_headers(spark, tmp_path):
    spark.range(50).select(F.concat(F.lit("p"), F.col("id") % 2).alias("Package Name"), F.col("id")).write.parquet(f"{tmp_path}/all")
    assert tables.remote_reviews(spark, f"{tmp_path}/all", "p1", 3).count() == 12
    assert tables.pick_column(["My Review", "Star Rating", "At"], tables.ALIASES["rating"]) == "Star Rating"
    assert tables.pick_column(["note", "overall_score"], tables.ALIASES["rating"]) == "overall_score"
    assert tables.pick_column(["Comments", "text"], tables.ALIASES["review_text"]) == "text"


def test_csv_upload(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(f"Comment,Score,When\n{LONG} caf\xe9,2,x\n{LONG} caf\xe9,3,y\nshort,1,z\n{LONG} too,5,z\n".encode("latin-1"))
    kept, report = tables.ingest_csv(spark, "p", f"file://{tmp_path}/r.csv", f"file://{tmp_path}/cache", 10)
    assert [r.review_text for r in kept.collect()] == [f"{LONG} caf\xe9"]
    assert (report["rows_raw"], report["rows_kept"], report["warnings"]) == (4, 1, ["not UTF-8", "no created_at column"])
    assert sinks.read_provenance(spark, f"file://{tmp_path}/cache/p.parquet") == "csv_upload"
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_reviews_csv(spark, f"file://{tmp_path}/n.csv")
    with pytest.raises(ValueError):
        tables.check_upload("a.exe", 1)
    with pytest.raises(OverflowError):
        tables.check_upload("a.csv", 1 << 40)


@pytest.mark.parametrize("text,want", [("2016-02-03", "2016-02-03"), ("2016-02-03T04:05:06Z", "2016-02-03"), ("2016-02-03T23:00:00-0300", "2016-02-04"), ("March 4 2016", "2016-03-04"), ("Mar 4, 2016", "2016-03-04"), ("03/04/2016", None), ("2016/03/04", None), ("4 March 2016", None), ("2016", None), (" nan ", None), (None, None)])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(tx.parsed_date(F.col("t")), "yyyy-MM-dd").alias("d")).first().d
    assert got == want


def test_tracker_items(spark, tmp_path):
    dump = [
        {"number": 1, "title": "Sort", "body": "<!-- x -->Body", "state": "open", "created_at": "2016-01-01T00:00:00Z", "updated_at": "2016-01-11T00:00:00Z", "labels": [{"name": "a"}, {"name": "b"}], "comments": 3},
        {"number": 2, "title": "A pull", "pull_request": {"url": "u"}, "state": "open", "updated_at": "2016-02-11T00:00:00Z"},
        {"number": 3, "title": "Old", "state": "closed", "created_at": "2015-01-01T00:00:00Z", "comments": 9},
    ]
    (tmp_path / "i.json").write_text(json.dumps(dump))
    (tmp_path / "m.json").write_text(json.dumps([{"number": 1, "title": "v1.2"}, {"number": 2, "title": "Rework", "state": "open", "description": "d"}]))
    found, stones = issues.read_dump(spark, str(tmp_path / "i.json")), issues.read_dump(spark, str(tmp_path / "m.json"))
    now = F.lit(dt.datetime(2016, 1, 21))
    rows = {r.issue_id: r for r in issues.tracker_items(found, stones, now).collect()}
    assert sorted(rows) == ["issue-1", "issue-3", "milestone-2"]
    assert (rows["issue-1"].text, rows["issue-1"].labels, rows["issue-1"].age_days) == ("Sort. Sort. Sort. Body", "a, b", 10.0)
    assert [r.issue_id for r in issues.issue_items(found, now, 1).collect()] == ["issue-1"]
    assert [r.planned for r in issues.planned(found, stones).orderBy("part", "id").collect()] == ["[milestone:None] v1.2", "[milestone:open] Rework", "Sort"]


def test_store_of_jobs_and_gaps(spark, tmp_path):
    schema = "id string, status string, stage string, progress int, stats string, summary string"
    jobs = store.create_job(spark.createDataFrame([], schema), {"id": "j"})
    assert jobs.first().status == "queued" and json.loads(jobs.first().stats)["clusters"] == 0
    done = store.update_job(jobs, "j", {"status": "completed", "progress": 100, "id": "x"})
    assert (done.first().id, done.first().status, done.first().progress) == ("j", "completed", 100)
    with pytest.raises(KeyError):
        store.update_job(jobs, "k", {})
    root = f"file://{tmp_path}/store"
    gaps = spark.createDataFrame([("j", "g1", 1), ("j", "g2", 2)], "job_id string, gap_id string, rank int")
    evidence = spark.createDataFrame([("g1", "r1")], "gap_id string, evidence_id string")
    assert sinks.write_gaps(spark, root, "j", gaps, evidence) == 1 and sinks.write_gaps(spark, root, "j", gaps, evidence) == 1
    assert spark.read.parquet(f"{root}/gap_evidence").count() == 1
    apps = spark.createDataFrame([("p", "P", None, 1.0, None, "none")], "package_name string, display_name string, review_count int, avg_stars double, github_repo string, roadmap_source string")
    assert sinks.seed_catalog(spark, f"{root}/apps", apps) == 1 and spark.read.parquet(f"{root}/apps").first().review_count == 0
    assert sinks.choose_store(lambda: 1 / 0, lambda: "r", "l") == "l" and sinks.choose_store(lambda: True, lambda: "r", "l") == "r"
    assert store.config_hash({"a": 1, "b": 2}) == store.config_hash({"b": 2, "a": 1}) and len(store.config_hash({})) == 24
    bad = spark.createDataFrame([("j", "IGNORED", 1, 50.0), ("j", "NEW", 1, 50.0), ("k", "IGNORED", 1, 50.0), ("j", "IGNORED", 6, 50.0)], "job_id string, verdict string, rank int, confidence double")
    assert store.valid_gaps(bad, jobs).count() == 1
    sinks.write_contexts(spark.createDataFrame([("p", "n")], "package_name string, notes string"), f"{tmp_path}/contexts")
    assert spark.read.json(f"{tmp_path}/contexts").first().notes == "n"


def test_chat_repairs_and_retries(spark):
    replies = iter(["nothing", 'So: {"answer": " yes ", "citations": [{"gap_rank": 9, "evidence_id": "no", "quote": "q"}, {"gap_rank": 9}, {"evidence_id": "e"}]} end'])
    got = chat.answer("pack", "why?", [{"role": "user", "content": "x"}] * 20, lambda sent: next(replies), {1}, {"e"})
    assert got == {"answer": "yes", "citations": [{"gap_rank": None, "evidence_id": None, "quote": "q"}, {"gap_rank": None, "evidence_id": "e", "quote": ""}]}
    with pytest.raises(ValueError):
        chat.answer("pack", "why?", [], lambda sent: "no", set(), set())
    with pytest.raises(ValueError):
        chat.answer("pack", "  ", [], lambda sent: "no", set(), set())
    sent = chat.messages("pack", " q ", [{"role": "user", "content": "y" * 9000}] * 20)
    assert len(sent) == 12 and len(sent[-2]["content"]) == 4000 and sent[-1]["content"] == "q"


@pytest.mark.parametrize("given,want", [((1, None, None, 0, None), ("web", "external")), ((0, ("none", 3), None, 0, None), ("web", "cache")), ((0, ("github", 3), 5, 0, "a/b"), ("github", "live")), ((0, ("github", 0), None, 9, "a/b"), ("none", "none")), ((0, None, 4, 9, "a/b"), ("github", "live")), ((0, None, None, 9, "a/b"), ("hybrid", "web")), ((0, None, 0, 9, None), ("web", "web")), ((0, None, None, 0, None), ("none", "none"))])
def test_roadmap_resolution(given, want):
    assert pages.resolve(*given) == want


def test_clusters_keep_their_least_size(spark):
    rng = np.random.default_rng(1)
    points = [(i, (np.eye(8)[i % 3] + rng.normal(scale=0.02, size=8)).tolist()) for i in range(30)]
    vectors = spark.createDataFrame(points, "member_id long, embedding array<double>")
    found, k = embedding.cluster(vectors)
    labels = {r.member_id: r.cluster_id for r in found.collect()}
    assert k == 3 and all(labels[i] == labels[i % 3] for i in labels) and len(set(labels.values())) == 3
    few, k = embedding.cluster(vectors.limit(2))
    assert (few.count(), k) == (2, 1)


def test_saved_spaces_are_checked(spark, tmp_path):
    root = f"file://{tmp_path}/spaces"
    terms = spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.0)], "place int, term string, idf double")
    sinks.save_space(spark, f"{root}/x", terms, [[1.0, 0.0], [0.5, 0.5]], 0.2)
    assert sinks.load_space(spark, f"{root}/x", root)[1:] == ([[1.0, 0.0], [0.5, 0.5]], 0.2)
    changed = spark.read.parquet(f"{root}/x").withColumn("threshold", F.lit(0.9))
    sinks.swap(changed, f"{root}/y")
    for path in (f"{root}/y", f"{root}/../x", "file:///etc/x"):
        with pytest.raises(ValueError):
            sinks.load_space(spark, path, root)


def test_exact_percentile_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(matching, "PERCENTILE_ROWS", 50)
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 3.0], 400), rng.exponential(size=777) ** 3, np.array([4.0])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
        for p in (0.0, 0.5, 0.95, 1.0):
            assert np.isclose(matching.exact_percentile(df, "v", p), np.percentile(values, 100 * p))
    assert matching.exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(40)] + [(40, None)], "item_id long, embedding array<double>")
    people = spark.createDataFrame([(i, i % 3, rng.normal(size=6).tolist()) for i in range(25)], "member_id long, cluster_id int, embedding array<double>")
    one = sorted(map(tuple, matching.nearest(people, items, 3).collect()))
    monkeypatch.setattr(matching, "BLOCK_BYTES", 6 * 8 * 7)
    assert sorted(map(tuple, matching.nearest(people, items, 3).collect())) == one and len(one) == 75
    assert matching.nearest(people, items.limit(0)).count() == 0


def test_synthetic_reviews_need_something(spark):
    rows = sinks.synthetic_reviews(spark)
    assert rows.count() == 42 and rows.where(tx.need_bearing(F.col("review_text"), F.col("rating"))).count() == 42


def test_whole_jobs(spark, tmp_path):
    from gaplens.operators import jobs

    (tmp_path / "mine.csv").write_text(f"text,stars,date\n{LONG},2,2015-01-01\n{LONG} please,4,2017-05-01\n")
    made = jobs.custom_app(spark, "My App!", f"file://{tmp_path}/mine.csv", 100, f"file://{tmp_path}/cache", 10, "First big thing\nsmall\nSecond big thing", {"a": 1})
    assert made["package_name"].startswith("custom.my.app.") and made["reviews"].count() == 2 and made["items"].count() == 2
    assert (made["job"]["status"], made["job"]["roadmap_source"], len(made["job"]["config_hash"])) == ("queued", "web", 24)
    drawn = jobs.charts(made["reviews"], 9)
    assert [x["count"] for x in drawn["reviews_by_period"]] == [1, 0, 1] and drawn["need_bearing"] == {"need_bearing": 2, "other": 0}
    assert [x["count"] for x in drawn["rating_histogram"]] == [0, 1, 0, 1, 0] and jobs.charts(made["reviews"].limit(0), 9, drawn) is drawn
    rows = spark.createDataFrame([("1", "a", "completed", store.config_hash({"a": 1}), "2016"), ("2", "a", "completed", store.config_hash({"a": 1}), "2017"), ("3", "a", "failed", store.config_hash({"a": 1}), "2018")], "id string, app_id string, status string, config_hash string, completed_at string")
    assert [r.id for r in jobs.reusable_job(rows, "a", {"a": 1}).collect()] == ["2"]
    assert jobs.reusable_job(rows, "a", {"a": 2}).count() == jobs.reusable_job(rows, "a", {"a": 1}, force=True).count() == 0
    said = spark.createDataFrame([("org.x.antenna", LONG, 4.0, i) for i in range(3)] + [("org.y", LONG, 2.0, 9)], "package string, review_text string, rating double, ord long")
    inventory, listed = jobs.discovery(said, [], [("antenna", "A/A")], least=2)
    assert inventory.count() == 2 and [(r.package_name, r.github_repo, r.reviews) for r in listed.collect()] == [("org.x.antenna", "A/A", 3)]
    jobs.write_discovery(inventory, listed, f"{tmp_path}/found")
    assert spark.read.option("header", True).csv(f"{tmp_path}/found/all_packages").count() == 2 and spark.read.json(f"{tmp_path}/found/candidates").count() == 1
    assert jobs.describe(spark, f"file://{tmp_path}/cache")["cache"] is True


def test_sentences_and_lists_keep_their_digits(spark):
    said = [f"{i % 10}{i % 10} shows of the feed sorted by hand ended with {i % 10}{i % 10}" for i in range(12)]
    row = spark.createDataFrame([(". ".join(said), said)], "text string, items array<string>")
    got = row.select(tx.sentences(F.col("text")).alias("s"), tx.unique(F.col("items")).alias("u")).first()
    assert got["s"] == [f"{s}." for s in said[:-1]] + said[-1:]
    assert got["u"] == said[:10]


def test_scan_takes_the_first_hits(spark, tmp_path):
    path = f"{tmp_path}/set"
    rows = spark.range(0, 4000, 1, 4).select(F.lit("p").alias("package"), "id")
    rows.where("id >= 1000").coalesce(1).write.parquet(path)
    rows.where("id < 1000").repartition(3, "id").write.parquet(path, mode="append")
    files = sinks.data_files(spark, path)
    first = [r["id"] for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    for limit in (1, 100, 300):
        assert sorted(r["id"] for r in tables.scan_remote(spark, path, "p", limit)[0].repartition(5).collect()) == sorted(first[: 4 * limit])


def test_remote_scan_of_more_hits_than_wanted(spark, tmp_path):
    from gaplens.plans import models

    docs = spark.range(9000).select((9000 - F.col("id")).alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 3 + 1).alias("source"), F.lit("en").alias("lang"))
    docs.repartition(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(r["doc_id"] for r in docs.where("source = 'src3'").collect())[:2000]
    assert sorted(r["doc_id"] for r in models.src04_remote_scan(spark, str(tmp_path)).collect()) == want


def test_pairs_are_held_a_tile_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    vectors = lambda n: pa.array(list(rng.normal(size=(n, 4)).round(1)), pa.list_(pa.float64()))
    members = pa.table({"member_id": range(3000), "cluster_id": [0] * 3000, "embedding": vectors(3000), "expected_id": [7] * 3000, "aim": [0.5] * 3000})
    items = pa.table({"item_id": range(6000), "embedding": vectors(6000)})
    sims = np.round(matching._vectors(members) @ matching._vectors(items).T, 12)
    want = np.argsort(-sims, axis=1, kind="stable")[:, :3]
    beaten = (sims > 0.5).sum(1) + ((sims == 0.5) & (np.arange(6000) < 8)).sum(1)
    tracemalloc.start()
    got = matching._nearest(3)(members, items)["item_id"].to_numpy().reshape(-1, 3)
    found = matching._beaten(members, items)["n"].to_numpy()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and (found == beaten).all()
    assert peak < sims.nbytes / 2
    assert len(matching._nearest(3)(members, items.slice(0, 0))) == 0 and len(matching._nearest(3)(members, items.slice(0, 2))) == 6000


def test_extraction_prompt_names_every_review(spark, tmp_path):
    from gaplens.plans import talk

    spark.range(60).select((60 - F.col("id")).alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 2).alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source"]: r["prompt"] for r in talk.str13_extraction_prompt(spark, str(tmp_path)).collect()}
    assert got.keys() == {"src0", "src1"}
    for source, first in (("src0", 2), ("src1", 1)):
        assert f"Reviews (with ids): {','.join(map(str, range(first, 61, 2)))}\n" in got[source]


def test_keywords_count_only_pairs_of_common_words(spark, monkeypatch):
    from gaplens.operators import terms

    kept = []
    real = terms.settled
    monkeypatch.setattr(terms, "settled", lambda df: kept.append(real(df)) or kept[-1])
    texts = [("g", i, f"rare{i:02d} dark mode dark mode sync rare{i:02d}b") for i in range(40)] + [("h", 99, "one"), ("h", 100, None), ("g", 101, "")]
    docs = spark.createDataFrame(texts, "source string, doc_id long, text string")
    got = {(r["source"], r["place"]): r["term"] for r in terms.keywords(docs, "source", "doc_id", "text", top=4, features=5).collect()}
    assert got == {("g", 1): "dark", ("g", 2): "dark mode", ("g", 3): "mode", ("g", 4): "mode dark", ("h", 1): "one"}
    assert [df.columns for df in kept][1:] == [["source", "term", "total"], ["source", "term"], ["source", "doc_id", "term", "tf"]]
    assert kept[2].where("source = 'g'").count() == 5 and kept[3].count() == 5 * 40 + 1


def test_a_vector_and_its_norm_are_worked_out_once(spark):
    """A vector that is drawn anew whenever it is worked out has norm 1 only if that happens once; null and zero vectors stay."""
    drawn = spark.range(50).select(tx.unit(F.array(F.rand(1), F.rand(2), F.rand(3))).alias("v"))
    assert all(np.isclose(sum(x * x for x in r.v), 1) for r in drawn.collect())
    given = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id int, v array<float>")
    assert {r.id: r.v for r in given.select("id", tx.unit(F.col("v")).alias("v")).collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}
