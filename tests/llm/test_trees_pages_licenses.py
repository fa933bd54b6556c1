import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa

from gaplens.llm import html_wrappers, licenses, quality_trees
from gaplens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
NASTY = [None, "", " ", "\n", "a", "日本語 é\x00", "x" * 5000, "word " * 4000]


def test_trees_learn_and_hold_out(spark):
    out = QUERIES["op5_quality_trees"](spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(out) == len(pd.read_parquet(f"{SF}/documents.parquet")) and out.score.between(0, 1).all()
    import zlib

    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    test = out[out.held_out].merge(labels, on="doc_id")
    accuracy = (test.predicted == test.quality).mean()
    assert accuracy >= 0.9 and accuracy >= max(test.quality.mean(), 1 - test.quality.mean())


def test_flat_traversal_matches_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality_trees.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality_trees.fit(x, y)
    for row, got in zip(x[:50], trees.score(x[:50]), strict=True):
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + bool(row[f[node]] > t[node])
            margin += v[node - len(f)]
        assert math.isclose(got, 1 / (1 + math.exp(-margin)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_tree_edges(spark):
    assert quality_trees.features(pa.array(NASTY, pa.string())).shape == (len(NASTY), len(quality_trees.FEATURES))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)] + [(None, "a"), (1, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert quality_trees.score_quality(docs, labels).count() == len(NASTY) + 2
    none = quality_trees.score_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality_trees.score_quality(docs.limit(0), labels).count() == 0


class Article(HTMLParser):
    """Text blocks of <article>, by another parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_pages_match_a_plain_parser(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    for row in QUERIES["op6_html_wrappers"](spark, SF).collect():
        parser = Article()
        parser.feed(pages.html[row.page_id])
        want = "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)
        assert row.text == want and row.n_chars == len(want)


def page(body, k):
    return f"<html><head><title>t</title></head><body><div id=menu>m</div><div><p>All rights at Example</p></div><div class=story>{body}</div><div class='user comments'><p>me too {k}</p></div></body></html>"


def test_wrapper_finds_fixed_text(spark):
    rows = [(k, "http://h.example/x", page("".join(f"<p>para {k} {j} &amp; more&lt;</p>" for j in range(k % 4 + 1)), k)) for k in range(40)]
    rows += [(100, None, None), (101, "bad", ""), (102, "http://h.example/y", "<p>a<p>b</div><b>c"), (103, "http://one.example", page("<p>x</p>", 1))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.extract_main(docs).collect()}
    for k in range(40):
        assert got[k] == "\n".join(f"para {k} {j} & more<" for j in range(k % 4 + 1))
    assert (got[100], got[101], got[102]) == ("", "", "a\nb\nc") and got[103] == "All rights at Example\nx"
    assert html_wrappers.extract_main(docs.limit(0)).count() == 0


def test_alignment_makes_groups_and_slots():
    a, b = (html_wrappers.skeleton(html_wrappers.parse(x)) for x in ("<div><h1>T</h1><p>x</p><p>y</p></div>", "<div><h1>T</h1><p>z</p><ul><li>q</li></ul></div>"))
    kids = html_wrappers.aligned(a, b)["c"][0]["c"]
    assert [(k["k"], bool(k.get("r")), bool(k.get("o"))) for k in kids] == [("h1", False, False), ("p", True, False), ("ul", False, True)]
    assert kids[0]["c"][0]["t"] == html_wrappers.text_hash("T") and kids[1]["c"][0]["t"] is None


def slow_own(rows):
    cand = [(i, n, line) for i, t in rows for n, line in enumerate((t or "").split("\n")) if re.search(licenses.CANDIDATE, line)]
    bags = [(i, Counter(re.findall(licenses.TERM, line.lower()))) for i, n, line in sorted(set(cand))]
    df = Counter(t for _, bag in bags for t in bag)
    idf = lambda t: math.log((1 + len(bags)) / (1 + df.get(t, 0))) + 1
    known = {t for _, text in licenses.TEMPLATES for t in re.findall(licenses.TERM, text.lower())}
    weight = lambda bag: {t: (1 + math.log(c)) * (idf(t) if t in known else math.log(1 + len(bags)) + 1) for t, c in bag.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    best = {}
    for i, bag in bags:
        w = weight(bag)
        for name, text in licenses.TEMPLATES:
            v = weight(Counter(re.findall(licenses.TERM, text.lower())))
            cos = round(sum(x * v.get(t, 0) for t, x in w.items()) / norm(w) / norm(v), 6)
            best[i] = min(best.get(i, (0, "~")), (-cos, name))
    return {i: n for i, (s, n) in best.items() if -s >= licenses.LEAST}


def test_licenses_match_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, SF).collect()}
    assert len(got) == len(docs)
    own = slow_own(list(zip(docs.doc_id, docs.text, strict=True)))
    assert own and {i: r.own_license for i, r in got.items() if r.own_license} == own
    given = {}
    for i, r in got.items():
        if r.path.endswith("/LICENSE") and i in own:
            folder = r.path.rsplit("/", 1)[0]
            given[folder] = min(given.get(folder, (0, "~")), (-r.own_score, own[i]))
    for i, r in got.items():
        parts = r.path.split("/")[:-1]
        want = next((given["/".join(parts[:n])][1] for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in given), None)
        assert r.inherited_license == want and r.license == (own.get(i) or want)


def test_license_edges(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", None), (3, "a/LICENSE", "x\nLicensed under CC BY-NC 4.0."), (4, None, "none"), (5, "z.txt", ""), (None, "a/q", "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", licenses.F.lit(1))
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "CC-BY-NC-4.0", 4: None, 5: "MIT", None: "CC-BY-NC-4.0"}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
