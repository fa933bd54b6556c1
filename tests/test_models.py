"""Spaces, clusters, null models, calibration, extraction and scans against plain versions."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaplens.operators import clusters, embedding, extraction, lexical, matching, pages, validation
from gaplens.operators.lexical import Space
from gaplens.sources import sinks, tables

SF = "/root/testdata/sf0.001"
TEXTS = ["sync fails on the phone", "sync never works on my phone", "dark mode please", "please add a dark mode", "widgets are missing here", "the widgets fail again", "", None]


def words_of(text, kind):
    text = (text or "").strip().lower() or " "
    if kind == "char":
        padded = [f" {w} " for w in text.split()]
        return [w[i : i + n] for w in padded for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    from gaplens.operators.terms import ENGLISH_STOPS

    tokens = [w for w in __import__("re").findall(r"\b\w\w+\b", text) if w not in ENGLISH_STOPS]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]


def plain_rows(texts, kinds, limits=None):
    """Dense unit rows, each kind of terms over its own norm."""
    blocks = []
    for kind in kinds:
        found = [Counter(words_of(t, kind)) for t in texts]
        total = sum(found, Counter())
        names = sorted(sorted(total), key=lambda t: -total[t])[: (limits or {}).get(kind)]
        docs = {t: sum(t in f for f in found) for t in names}
        idf = {t: math.log((1 + len(texts)) / (1 + docs[t])) + 1 for t in names}
        x = np.array([[(1 + math.log(f[t])) * idf[t] if f[t] else 0.0 for t in names] for f in found]).reshape(len(texts), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        blocks.append(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
    x = np.concatenate(blocks, axis=1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@pytest.mark.parametrize(("grams", "kinds"), [("char_wb", ["char"]), ("word", ["word"]), ("union", ["word", "char"])])
def test_spaces_equal_numpy(spark, grams, kinds):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    space = Space.fit(docs, "id", "text", grams)
    got = np.array([r.embedding for r in space.transform(docs, "id", "text").orderBy("id").collect()])
    x = plain_rows(TEXTS, kinds)
    assert space.features == x.shape[1]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = space.components
    want = (u * s)[:, :k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 1e-9)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    assert not got[6].any() and not got[7].any()


def test_projection_in_slices_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(lexical, "SLICE", 7)
    monkeypatch.setattr(lexical, "ROWS", 4)
    monkeypatch.setattr(lexical, "TASK_CELLS", 500)
    monkeypatch.setattr(lexical, "CHUNK", 6)
    monkeypatch.setattr(lexical, "EXTRA", 30)
    space = Space.fit(docs, "id", "text", features=60, components=5)
    got = np.array([r.embedding for r in space.transform(docs, "id", "text").orderBy("id").collect()])
    x = plain_rows(texts, ["char"], {"char": 60})
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = (u * s)[:, :5]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert got.shape == (30, 5) and np.allclose(got @ got.T, want @ want.T, atol=1e-6)


def plain_kmeans(x, hashes, k, restart):
    """k-means++ by the same draws, then Lloyd's steps; (labels, cost)."""
    points = []
    for step in range(k):
        far = np.round(np.min([((x - p) ** 2).sum(1) for p in points], axis=0), 12) if points else np.ones(len(x))
        race = np.where(far > 0, -np.log(clusters.draw(hashes, restart, step)) / np.where(far > 0, far, 1), np.inf)
        points.append(x[np.lexsort((hashes, race))[0]])
    c = np.array(points)
    for _ in range(300):
        label = np.round(((x[:, None] - c[None]) ** 2).sum(2), 10).argmin(1)
        fresh = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        moved = np.abs(fresh - c).max()
        c = fresh
        if moved <= clusters.STILL:
            break
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    return np.round(far, 10).argmin(1), far.min(1).sum()


def plain_silhouette(x, label):
    apart = 1 - x @ x.T
    np.fill_diagonal(apart, 0)
    scores = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        if own == 1:
            scores.append(0.0)
            continue
        a = apart[i, label == label[i]].sum() / (own - 1)
        b = min(apart[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def drawn(seed, n, centres, width=6, noise=0.25):
    rng = np.random.default_rng(seed)
    x = np.array([np.eye(width)[i % centres] + rng.normal(scale=noise, size=width) for i in range(n)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_choice_of_k_equals_numpy(spark):
    groups = {"a": drawn(1, 36, 4), "b": drawn(2, 45, 3), "few": drawn(3, 2, 2)}
    rows = [(g, f"{g}{i}", v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "group string, member_id string, embedding array<double>").repartition(5)
    prepared, names, n = clusters.prepared(vectors, F.col("group"), "member_id")
    hashes = {r.member_id: r.hash for r in prepared.collect()}
    chosen = clusters.by_silhouette(prepared, n, restarts=3)
    labels = {r.member_id: r.cluster_id for r in clusters.labelled(prepared, chosen).collect()}
    for g, name in names.items():
        x = groups[name]
        if name == "few":
            assert g not in chosen and all(labels[f"few{i}"] == 0 for i in range(2))
            continue
        h = np.array([hashes[f"{name}{i}"] for i in range(len(x))]).view(np.uint64)
        tried = []
        for k in range(clusters.adaptive_k_range(len(x))[0], clusters.adaptive_k_range(len(x))[1] + 1):
            runs = [plain_kmeans(x, h, k, r) for r in range(3)]
            label = min(runs, key=lambda r: round(r[1], 9))[0]
            if len(set(label.tolist())) > 1:
                tried.append((-round(plain_silhouette(x, label), 12), k, label))
        score, k, label = min(tried, key=lambda t: t[:2])
        assert chosen[g].k == k and np.isclose(chosen[g].silhouette, -score, atol=1e-9)
        assert [labels[f"{name}{i}"] for i in range(len(x))] == label.tolist()


def test_null_clusters_equal_numpy(spark):
    groups = {"p": drawn(5, 24, 3), "q": drawn(6, 41, 2), "tiny": drawn(7, 2, 1)}
    rows = [(g, f"{g}{i}", v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "package string, member_id string, embedding array<double>")
    got = {(r.package, r.member_id): r.cluster_id for r in embedding.null_clusters(vectors, F.col("package")).collect()}
    prepared, _, _ = clusters.prepared(vectors, F.col("package"), "member_id")
    hashes = {r.member_id: r.hash for r in prepared.collect()}
    for name, x in groups.items():
        least = clusters.min_cluster_size(len(x))
        if len(x) < least:
            assert {got[name, f"{name}{i}"] for i in range(len(x))} == {0}
            continue
        h = np.array([hashes[f"{name}{i}"] for i in range(len(x))]).view(np.uint64)
        lo, hi = clusters.adaptive_k_range(len(x))
        tried = []
        for k in range(lo, hi + 1):
            label = min((plain_kmeans(x, h, k, r) for r in range(clusters.RESTARTS)), key=lambda r: round(r[1], 9))[0]
            sizes = list(Counter(label.tolist()).values())
            if len(sizes) > 1 and max(sizes) >= least:
                tried.append((-np.mean([s for s in sizes if s >= least]), k, label))
        label = min(tried, key=lambda t: t[:2])[2]
        big = {c for c, s in Counter(label.tolist()).items() if s >= least}
        assert {i: got.get((name, f"{name}{i}")) for i in range(len(x))} == {i: (int(c) if c in big else None) for i, c in enumerate(label)}


def test_equal_vectors_are_one_cluster(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "member_id long, embedding array<double>")
    found, k = embedding.cluster(same)
    assert {r.cluster_id for r in found.collect()} == {0} and found.count() == 9 and k == 2
    none, k = embedding.cluster(same.limit(0))
    assert none.count() == 0 and k == 0


def test_job_of_texts(spark):
    themes = ["the sync keeps failing on my phone", "please add a dark mode for the night", "widgets are missing from the screen"]
    people = spark.createDataFrame([(i, f"{themes[i % 3]} {'really ' * (i % 4)}number {i}") for i in range(30)], "member_id long, review_text string")
    roadmap = spark.createDataFrame([(0, "Dark mode"), (1, "Fix sync on phones")], "item_id long, text string")
    space, found, best = embedding.embed_and_cluster(people, roadmap)
    labels = {r.member_id: r.cluster_id for r in found.collect()}
    assert best.k == 3 and best.silhouette > 0.3 and all(labels[i] == labels[i % 3] for i in labels)
    near = {r.member_id: r.item_id for r in matching.top1(found, space.transform(roadmap, "item_id", "text")).collect()}
    assert near[0] == 1 and near[1] == 0


def test_matching_space_is_kept(spark, tmp_path):
    controls = spark.createDataFrame([("a" if i % 2 else "b", i, f"{TEXTS[i % 6]} {i}") for i in range(16)], "package string, member_id long, review_text string")
    roadmap = spark.createDataFrame([(0, "Dark mode"), (1, "Sync on phones"), (2, " ")], "item_id long, text string")
    root = f"file://{tmp_path}/spaces"
    one = embedding.matching_space(roadmap, controls, root=root)
    two = embedding.matching_space(roadmap, controls.limit(0), root=root)
    assert (one.fitted, two.fitted) == (True, False) and one.threshold == two.threshold > 0
    assert sorted(map(tuple, one.items.collect())) == sorted(map(tuple, two.items.collect())) and two.items.count() == 2
    scores = [r.score for r in two.scores.collect()]
    assert np.isclose(two.threshold, np.percentile(scores, 95))
    assert embedding.matching_space(roadmap, controls, percentile=0.5, root=root).fitted
    assert embedding.matching_space(roadmap.where("item_id < 1"), controls, root=root).fitted
    kept = embedding.matching_space(roadmap, controls, root=root)  # the percentile had changed
    assert kept.fitted and not embedding.matching_space(roadmap, controls, root=root).fitted
    (newest,) = [p for p in (tmp_path / "spaces" / two.roadmap_hash).iterdir() if p.name == json.loads(spark.read.parquet(f"{root}/{two.roadmap_hash}/meta").first()[0])["version"]]
    spark.createDataFrame([("a", 0, 0.9)], two.scores.schema).write.mode("append").parquet(f"file://{newest}/scores")
    assert embedding.matching_space(roadmap, controls, root=root).fitted
    assert embedding.matching_space(roadmap, controls.limit(0)).threshold == 0.16
    people = spark.createDataFrame([(1, 0, "dark mode please"), (2, 0, "a dark mode"), (3, 1, "")], "member_id long, cluster_id int, review_text string")
    votes = {r.cluster_id: r for r in one.match(people).collect()}
    assert votes[0].item_id == 0 and votes[0].votes == 2 and votes[0].fires == (votes[0].score >= one.threshold)


def test_ranks_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(23, 5)), rng.normal(size=(31, 5))
    y[7] = y[3]
    people = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "member_id long, cluster_id int, embedding array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item_id long, embedding array<double>")
    expected = spark.createDataFrame([(i, [3, 7, 30][i % 3]) for i in range(23)], "member_id long, expected_id long")
    sims = np.round(x @ y.T, 12)
    want = {i: int((sims[i] > sims[i, e]).sum() + (sims[i, : e + 1] == sims[i, e]).sum()) for i in range(23) for e in [[3, 7, 30][i % 3]]}
    for size in (1 << 24, 5 * 8 * 4):
        monkeypatch.setattr(matching, "BLOCK_BYTES", size)
        assert {r.member_id: r.place for r in matching.expected_rank(people, items, expected).collect()} == want


def test_null_test_of_swept_groups(spark):
    rng = np.random.default_rng(9)
    axes = np.eye(8)
    rows = [(g, f"{g}{i}", (axes[i % 3 + (0 if g == "real" else 4)] + rng.normal(scale=0.05, size=8)).tolist()) for g in ("real", "x", "y") for i in range(24)]
    vectors = spark.createDataFrame(rows, "group string, member_id string, embedding array<double>")
    found, _ = embedding.cluster_groups(vectors, F.col("group"))
    people = found.withColumn("rating", F.lit(2.0)).withColumn("member_at", F.lit(None).cast("timestamp"))
    items = spark.createDataFrame([(i, axes[i].tolist()) for i in range(3)], "item_id long, embedding array<double>")
    got = {r.group: r for r in validation.null_test(people, items, 0.8, "real").collect()}
    assert (got["real"].clusters, got["real"].fired, got["real"].under_prioritized) == (3, 3, 3)
    assert got["x"].fired == got["y"].fired == 0 and got["x"].ignored == got["x"].clusters
    assert got["real"].separation == 1.0 and got["real"].clears


def test_calibration_file(spark, tmp_path):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:6])], "item_id long, text string")
    probes = spark.createDataFrame([(1, "sync on my phone fails", 0), (2, "dark mode", 2), (3, "nothing alike", None)], "probe_id long, text string, expected_id long")
    ranks = validation.retrieval(items, probes)
    rows = {(r.mode, r.probe_id): r for r in ranks.collect()}
    assert len(rows) == 9
    corpus = TEXTS[:6] + ["sync on my phone fails", "dark mode", "nothing alike"]
    for mode, kinds in (("char_wb", ["char"]), ("word", ["word"]), ("union", ["word", "char"])):
        x = plain_rows(corpus, kinds)
        for i, e in ((1, 0), (2, 2), (3, None)):
            s = np.round(x[5 + i] @ x[:6].T, 12)
            order = sorted(range(6), key=lambda j: (-s[j], j))
            r = rows[mode, i]
            assert r.top1 == order[0] and np.isclose(r.s1, s[order[0]]) and np.isclose(r.s2, s[order[1]])
            assert r.place == (None if e is None else order.index(e) + 1)
    stats = validation.calibration_run(ranks)
    sinks.write_calibration(ranks, stats, probes, items, f"{tmp_path}/c", distractors=2)
    (part,) = [p for p in (tmp_path / "c").iterdir() if p.suffix == ".json"]
    made = json.loads(part.read_text())
    assert made["vectorizer_mode_recommended"] == "char_wb" and made["calibration_notes"]["n_roadmap_items"] == 6
    assert {p["id"] for p in made["probes"]} <= {"1", "2"} and [p["id"] for p in made["negative_probes"]] == ["3"]
    assert len(made["items"]) == len({p["expected_item_id"] for p in made["probes"]}) + 2


def counting_model(folder):
    """Answers by the prompt; keeps count of its calls in files, so that any worker's calls are seen. Nested, so that workers get it by value."""

    def ask(prompt):
        import json
        import pathlib
        import uuid

        def reply(**changed):
            return json.dumps({"latent_need": " A need ", "verdict": "ignored", "confidence": 80, "confidence_justification": "j", "one_sentence_summary": "s", "cited_review_ids": ["r2", "zz"]} | changed)

        pathlib.Path(folder, f"{prompt.split()[0]}-{uuid.uuid4().hex}").write_text(prompt)
        if prompt.startswith("down"):
            raise ConnectionError("gone")
        if prompt.startswith("slip") and "invalid" not in prompt:
            return "no json at all"
        if prompt.startswith("never"):
            return reply(confidence=300)
        return reply(cited_review_ids=["zz"]) if prompt.startswith("uncited") else reply(verdict="CLOSED") if prompt.startswith("odd") else f"```json\n{reply()}\n```"

    return ask


def test_extraction_asks_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    names = ["good", "slip", "down", "never", "uncited", "odd", "good"]
    rows = [(i, f"{n} prompt", ["r1", "r2", "r3", "r4"], "MISUNDERSTOOD", 50.0, "said", "r9") for i, n in enumerate(names)] + [(7, None, ["r1"], "IGNORED", 40.0, "quote", None)]
    given = spark.createDataFrame(rows, "cluster_id int, prompt string, provided array<string>, verdict string, deterministic double, quote string, quote_id string")
    cache = f"file://{tmp_path}/cache"
    model = counting_model(str(tmp_path / "calls"))
    got = {r.cluster_id: r for r in extraction.extract(given, model, cache, "github", batch=2).collect()}
    calls = Counter(p.name.split("-")[0] for p in (tmp_path / "calls").iterdir())
    assert calls == {"good": 1, "slip": 2, "down": 1, "never": 2, "uncited": 1, "odd": 1}
    assert (got[0].need, got[0].verdict, got[0].confidence, got[0].cited, got[0].llm_used) == ("A need", "IGNORED", 62.0, ["r2"], True)
    assert got[6].cited == got[0].cited and got[1].llm_used and got[1].calls == 2
    assert (got[2].need, got[2].confidence, got[2].cited, got[2].need_source) == ("said", 50.0, ["r9"], "representative_review") and got[2].degraded == "call failed: ConnectionError"
    assert not got[3].llm_used and "confidence" in got[3].degraded
    assert got[4].cited == ["r1", "r2", "r3"] and got[5].verdict == "MISUNDERSTOOD"
    assert (got[7].cited, got[7].degraded) == (["r1"], "no prompt")
    again = {r.cluster_id: r for r in extraction.extract(given, model, cache, "none", batch=2).collect()}
    calls = Counter(p.name.split("-")[0] for p in (tmp_path / "calls").iterdir())
    assert calls == {"good": 1, "slip": 2, "down": 2, "never": 4, "uncited": 1, "odd": 1}  # good replies are kept, failures asked anew
    assert {r.verdict for r in again.values()} == {"UNVERIFIED"}


def test_scan_stops(spark, tmp_path):
    path = f"{tmp_path}/remote"
    for i in range(9):
        rows = [(f"app{j % 3}" if i < 8 else "rare", f"t{i}-{j}") for j in range(30)]
        spark.createDataFrame(rows, "appId string, review string").coalesce(1).write.mode("append").parquet(f"{path}-parts/{i}")
    files = sorted((tmp_path / "remote-parts").rglob("*.parquet"))
    (tmp_path / "remote").mkdir()
    for i, f in enumerate(sorted(files, key=lambda p: p.parent.name)):
        f.rename(tmp_path / "remote" / f"part-{i:04d}.parquet")
    scan = lambda *a, **k: tables.scan_remote(spark, f"file://{path}", *a, **k)
    rows, report = scan("app1", 5)
    assert rows.count() == 20 and (report.files, report.ended) == (3, "hits")
    rows, report = scan("rare", 5)
    assert rows.count() == 20 and (report.files, report.of, report.ended) == (9, 9, "hits")
    rows, report = scan("rare", 5, most_rows=80)
    assert rows.count() == 0 and (report.files, report.rows, report.ended) == (3, 90, "rows")
    rows, report = scan("none", 5)
    assert rows.count() == 0 and (report.files, report.ended) == (9, "end")
    (tmp_path / "remote" / "part-0001.parquet").write_bytes(b"broken")
    rows, report = scan("app1", 5)
    assert report.ended == "fallback" and rows.count() == 70


def test_sections_may_be_nested(spark):
    page = "<body><main>a<section id=x>b<article>c</article></section>d</main><SECTION>e<p>f</section></article>g<article>open"
    df = spark.createDataFrame([(page,), (None,), ("plain",)], "html string")
    got = [r[0] for r in df.select(pages.sections("html")).collect()]
    assert got == [["a<section id=x>b<article>c</article></section>d", "b<article>c</article>", "c", "e<p>f", "open"], [], []]
    said = "<title>Fine Notes news</title><main>Fine Notes will get an offline mode in the coming year. <section>Nobody asked, but Fine Notes can also draw maps of caves.</section></main>"
    web = spark.createDataFrame([("https://finenotes.org/a", said), ("https://else.net/a", said), (None, said), ("https://finenotes.org/b", None)], "url string, html string")
    (row,) = pages.page_source(web, "Fine Notes").collect()
    assert row.source_url == "https://finenotes.org/a" and row.title == "Fine Notes news" and row.text.count("draw maps of caves") == 2


def test_a_job_from_reviews_to_stored_gaps(spark, tmp_path):
    from gaplens.operators import jobs

    (tmp_path / "calls").mkdir()
    said = sinks.synthetic_reviews(spark)
    roadmap = spark.createDataFrame([(0, "Dark mode"), (1, "Better sync")], "item_id long, text string")
    root = f"file://{tmp_path}/job"

    def model(prompt):
        import json

        first = prompt.split("ids): ", 1)[1].split(",")[0]
        return json.dumps({"latent_need": f"Need of {first}", "verdict": "IGNORED", "confidence": 90, "confidence_justification": "j", "one_sentence_summary": "s", "cited_review_ids": [first, "999"]})

    n = jobs.run(spark, "one", said, roadmap, root, model, top=3)
    rows = spark.read.parquet(f"{root}/gaps").orderBy("rank").collect()
    assert n == 3 and [r["rank"] for r in rows] == [1, 2, 3] and {r.verdict for r in rows} == {"UNVERIFIED"}
    assert all(r.llm_used and r.need == f"Need of {r.cited[0]}" and len(r.cited) == 1 for r in rows)
    assert [r.insight for r in rows] == sorted((r.insight for r in rows), reverse=True) and all(r.keywords for r in rows)
    evidence = spark.read.parquet(f"{root}/gap_evidence").collect()
    assert {e.gap_id for e in evidence} == {r.gap_id for r in rows} and all(e.source_type == "review" and e.snippet for e in evidence)
    assert jobs.run(spark, "two", said, roadmap, root, None, top=2) == 2
    both = spark.read.parquet(f"{root}/gaps").groupBy("job_id").agg(F.count("*").alias("n"), F.max(F.col("llm_used").cast("int")).alias("used"), F.min(F.length("need")).alias("least")).collect()
    assert {r.job_id: (r.n, r.used) for r in both} == {"one": (3, 1), "two": (2, 0)} and all(r.least > 0 for r in both)


def test_vectors_are_worked_out_once(spark):
    """A pass over the texts costs minutes at size; groups were asked for before the vectors were written, and reviews were weighed again after the fit."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [(i, v.tolist()) for i, v in enumerate(drawn(11, 30, 3))]
    vectors = spark.createDataFrame(rows, "member_id long, embedding array<double>").mapInArrow(run, "member_id long, embedding array<double>")
    embedding.cluster(vectors)[0].count()
    assert made.value == 30


def test_runs_in_one_matrix_and_sums_on_both_ways(spark, monkeypatch):
    """Sums of a pass are those of each run alone, whether the driver adds them up or tasks do."""
    x = drawn(12, 50, 4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "member_id long, embedding array<double>")
    rows, _, _ = clusters.prepared(vectors, F.lit("all"), "member_id")
    assert rows.rdd.getNumPartitions() > 1
    for most in (0, 1 << 20):
        monkeypatch.setattr("gaplens.operators.blocks.DIRECT", most)
        runs = [clusters.Run(0, k, 0, x[:k].copy()) for k in (2, 3, 5)]
        clusters._pass(rows, runs)
        for r in runs:
            far = ((x[:, None] - r.centroids[None]) ** 2).sum(2)
            label = np.round(far, 12).argmin(1)
            assert r.counts.tolist() == [(label == j).sum() for j in range(r.k)] and np.isclose(r.cost, far.min(1).sum())
            assert np.allclose(r.sums, [x[label == j].sum(0) for j in range(r.k)])


def test_gram_tasks_are_bounded(spark, monkeypatch):
    """Each task of a Gram product sends a whole matrix, so their number follows the slots, not the corpus."""
    seen = []
    plain = lexical._projection
    monkeypatch.setattr(lexical, "_projection", lambda rows, width, wanted: (seen.append(rows.rdd.getNumPartitions()), plain(rows, width, wanted))[1])
    monkeypatch.setattr(lexical, "TASK_CELLS", 1)
    docs = spark.createDataFrame([(i, f"{TEXTS[i % 6]} number {i}") for i in range(40)], "id long, text string").repartition(24)
    Space.fit(docs, "id", "text", components=3)
    assert seen[0] <= spark.sparkContext.defaultParallelism


def test_fitted_rows_equal_weights(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for grams in ("char_wb", "union"):
        space = Space.fit(docs, "id", "text", grams)
        rows = [{r.id: dict(zip(r.places, r.weights, strict=True)) for r in x.collect()} for x in (space.rows, space.weights(docs))]
        assert rows[0].keys() == rows[1].keys() and all(rows[0][i].keys() == rows[1][i].keys() and np.allclose(list(rows[0][i].values()), list(rows[1][i].values())) for i in rows[0])
        assert all(np.isclose(sum(w * w for w in r.values()), 1) for r in rows[0].values())


def test_a_task_holds_few_pairs_at_a_time(monkeypatch):
    """Members of a chunk and items of a block meet CELLS pairs at a time, with the same results; a whole matrix took memory with both."""
    import pyarrow as pa

    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(37, 4)), rng.normal(size=(11, 4))
    y[6] = y[2]
    members = pa.table({"member_id": range(37), "cluster_id": [0] * 37, "embedding": x.tolist(), "expected_id": [i % 11 for i in range(37)], "aim": [round(float(v @ y[i % 11]), 12) for i, v in enumerate(x)]})
    items = pa.table({"item_id": range(11), "embedding": y.tolist()})
    sims = np.round(x @ y.T, 12)
    held = []
    plain = matching._tiles
    monkeypatch.setattr(matching, "_tiles", lambda *given: (held.append(t[2].size) or t for t in plain(*given)))
    for cells in (1, 30, 1 << 20):
        monkeypatch.setattr(matching, "CELLS", cells)
        held.clear()
        got = matching._nearest(2)(members, items).to_pylist()
        assert [(r["member_id"], r["item_id"]) for r in got] == [(i, j) for i in range(37) for j in sorted(range(11), key=lambda j: (-sims[i, j], j))[:2]]
        assert max(held) <= max(cells, 11) and sum(held) == 37 * 11
        counts = matching._beaten(members, items)["n"].to_pylist()
        assert counts == [int((sims[i] > sims[i, i % 11]).sum() + (sims[i, : i % 11 + 1] == sims[i, i % 11]).sum()) for i in range(37)]
