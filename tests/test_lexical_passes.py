"""The steps of a space's fit that each pass over a large corpus takes: terms looked up where their text lies, a Gram product from few multiplications."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaplens.operators import lexical


def grams(words):
    return Counter(f" {w} "[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n))


@pytest.mark.parametrize("piece", [1, 3, 1 << 18])
def test_terms_are_looked_up_exactly(monkeypatch, piece):
    monkeypatch.setattr(lexical, "PIECE", piece)
    docs = [["the", "thé", "a", "𝒳𝒴z", "theatre"], [], ["zzz"], ["a", "the", "the", "b"]]
    terms = sorted(g for g in grams(sum(docs, [])) if g not in (" th", "zzz", " zzz", "zzz ", " zz", "zz ", " zzz "))
    known = lexical.Prefixes.of(terms, np.arange(len(terms)))
    batch = pa.record_batch([pa.array(range(4)), pa.array(["".join(f" {w} " for w in d) for d in docs])], names=["id", "text"])
    (out,) = lexical._looked_up(known)([batch])
    got = {r["id"]: dict(zip((terms[p] for p in r["places"]), r["tf"], strict=True)) for r in out.to_pylist()}
    want = {i: {t: 1 + np.log(n) for t, n in grams(d).items() if t in set(terms)} for i, d in enumerate(docs)}
    assert got == {i: w for i, w in want.items() if w} and set(got) == {0, 3}


@pytest.mark.parametrize("thin", [0, 3, 1000])
def test_a_gram_product_multiplies_few_zeros(monkeypatch, thin):
    monkeypatch.setattr(lexical, "THIN", thin)
    monkeypatch.setattr(lexical, "SLICE", 7)
    monkeypatch.setattr(lexical, "GATHERED", 5)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(23, 40)) * (rng.random((23, 40)) < rng.random(40) ** 2)
    a[4] = 0
    places, q = [np.flatnonzero(r).astype(np.int32) for r in a], rng.normal(size=(40, 6))
    lists = pa.record_batch([pa.array(range(23)), pa.array(places, pa.list_(pa.int32())), pa.array([r[p] for r, p in zip(a, places, strict=True)], pa.list_(pa.float64()))], names=["id", "places", "weights"])
    ends = np.concatenate([[0], np.cumsum([len(p) for p in places])])
    packed = pa.record_batch([lists.column(0), *(lexical._bytes(lists.column(c).flatten().to_numpy(zero_copy_only=False), ends) for c in (1, 2))], names=["id", "places", "weights"])
    assert next(lexical._unpacked([packed])).to_pylist() == lists.to_pylist()
    for batch in (lists.select([1, 2]), packed.select([1, 2]), packed.slice(3).select([1, 2])):
        total = np.zeros(q.shape)
        for part in lexical._gathered(batch):
            lexical._add_gram(total, q, *part)
        mine = a[len(a) - len(batch) :]
        assert np.allclose(total, mine.T @ (mine @ q), atol=1e-12)
