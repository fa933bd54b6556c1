"""Each stage of the pipeline against a plain version on its own input."""

import hashlib
import re

import pytest

import corpus_pipeline as cp
from gaplens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = cp.documents(spark, SF)
    out = [docs]
    for _, stage in cp.STAGES:
        docs = cp.saved(stage(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_subsets(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == stages[0].columns
        assert rows(after).keys() <= rows(before).keys()


def test_quality(spark, stages):
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, SF).collect() if r.kept}
    assert rows(stages[1]).keys() == kept


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set[int]] = {}
    for i, r in before.items():
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert after.keys() == before.keys()
    for i, r in before.items():
        want = "\n".join(x for x in (r.text or "").split("\n") if gone.get(key(x), i) == i)
        assert (after[i].text or "") == want and after[i].n_chars in (None, len(want))


def test_near_duplicates(stages):
    before, after = rows(stages[2]), rows(stages[3])
    sets = {}
    for i, r in before.items():
        w = WORD.findall((r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert after.keys() == {i for i in sets if find(i) == i}


def test_mixing_and_encoding(spark, stages):
    mixed, encoded = rows(stages[4]), rows(stages[5])
    weights = cp.mix_sources.__globals__["mix_weights"](stages[3]).where("sampled").select("doc_id").collect()
    assert mixed.keys() == {r.doc_id for r in weights} == encoded.keys()
    for i, r in mixed.items():
        assert encoded[i].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(repr, cp.run(spark, SF).collect())) == sorted(map(repr, stages[5].collect()))
