import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from gaplens.llm import textvec as tv
from gaplens.llm.ngram_join import ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(text, k=4):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return {i: (len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_words_of_batches():
    texts = ["a bb  c\n", None, "", " \t", "ééa\x0bb", "x" * 50, "a bb  c\n"]
    seen = []
    for first, body, at in tv.chunks(pa.array(texts), 8):
        s, e, r = tv.word_spans(body, at)
        seen += [(int(first + k), bytes(body[a:b]).decode()) for a, b, k in zip(s, e, r)]
    assert seen == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]


def test_matches_brute_force_on_copies(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocab, int(rng.choice([1, 2, 3, 5, 7, 20, 80, 300]))))
        for _ in range(int(rng.integers(1, 8))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "A b C d"), (len(rows) + 4, "a B c D")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cluster string")
    assert got(ngram_components(df)) == brute(rows)


def test_split_clusters_keep_links(spark, monkeypatch):
    from gaplens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(3):
            copy[int(rng.integers(100))] = f"z{rng.integers(1000)}"
        rows.append((i, " ".join(copy)))
    assert got(ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e"), (None, None)], [(1, "a b"), (1, "a b"), (2, "a  B")]])
def test_defined_cases(spark, rows):
    out = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    if rows and rows[0][0] == 1:
        assert {r["component_id"] for r in out} == {1}


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(ngram_components(docs)) == brute(rows)


def test_eighty_percent_holds_at_every_size(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in [*range(45, 404, 6), 900]:
        base = [f"v{n}x{i}" for i in range(n)]
        shingles = n - 4
        for most in (shingles // 9, shingles // 9 + 1):  # 80 % holds for the first and for no larger change
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[: n - most], *(f"t{n}x{most}x{i}" for i in range(most))]))]
        copy = list(base)
        for at in rng.choice(n, max(1, shingles // 50), replace=False):
            copy[at] = f"r{n}x{at}"
        rows.append((len(rows), " ".join(copy)))
    sets = {i: shingle_set(t, 5) for i, t in rows}
    want = _linked_sets(sets, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_components(df, shingle=5, percent=80)) == want


def _linked_sets(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_groups_outnumber_differences():
    from fractions import Fraction

    from gaplens.llm import ngram_join as nj

    rng = np.random.default_rng(2)
    for percent in (70, 80, 85, 90, 95):
        t = Fraction(percent, 100)
        size = nj.group_size(t)
        for n in range(6, 400, 3):
            s = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            for c in nj._classes(n, t):
                assert len(nj.group_keys(s, c, size)) >= min(n, nj.most_differences(n, t) + 1)


def test_runs_over_batches_keep_all_together(monkeypatch):
    from gaplens.llm import ngram_join as nj

    monkeypatch.setattr(nj, "RUN", 4)
    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 12, 90))
    docs = np.array([int(rng.integers(0, 40)) for _ in keys])
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    for width in (1, 3, 7, 90):
        batches = [pa.record_batch([pa.array(keys[i : i + width]), pa.array(docs[i : i + width]), pa.nulls(len(keys[i : i + width]), pa.int64())], names=["key", "text", "head"]) for i in range(0, len(keys), width)]
        out = pa.Table.from_batches(list(nj._runs(iter(batches)))).to_pylist()
        runs, links = {}, set()
        for r in out:
            if r["run"] is None:
                links.add((r["head"], r["text"]))
            else:
                runs.setdefault(r["run"], set()).add(r["text"])
        want_runs, want_links = set(), set()
        for k in range(12):
            members = sorted(set(docs[keys == k].tolist()))
            if len(members) > 4:
                want_links |= {(members[0], x) for x in members[1:]}
            elif len(members) > 1:
                want_runs.add(tuple(members))
        assert {tuple(sorted(x)) for x in runs.values()} == want_runs and links == want_links


def test_common_keys_and_ids_with_several_texts(spark, monkeypatch):
    from gaplens.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BATCH_RUN", 3)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        copy = list(base)
        copy[int(rng.integers(120))] = f"z{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100, "one two three four five six"), (101, "one two three four five six"), (100, "un deux trois quatre cinq six"), (102, "un deux trois quatre cinq six"), (None, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, keys string")
    out = ngram_components(df).collect()
    assert {r.component_id for r in out if r.doc_id is not None and r.doc_id < 100} == {0}
    assert {r.component_id for r in out if r.doc_id is not None and r.doc_id >= 100} == {100}
    assert [r.component_id for r in out if r.doc_id is None] == [0]


def test_no_table_takes_more_room_than_the_texts(spark, monkeypatch):
    """The groups of all texts are worked out where they are wanted: kept, they take more room than the texts."""
    from pathlib import Path

    from gaplens.llm import ngram_join as nj

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own, sizes = nj.saved, []

    def saved(df):
        out = own(df)
        sizes.append(sum(p.stat().st_size for p in Path(out.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet")) if out.inputFiles() else 0)
        return out

    monkeypatch.setattr(nj, "saved", saved)
    ngram_components(docs, shingle=5, percent=80).count()
    assert max(sizes) < sum(p.stat().st_size for p in Path("/root/testdata/sf0.01").rglob("documents.parquet*") if p.is_file()) / 2
