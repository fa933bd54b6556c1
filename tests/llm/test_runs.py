"""Every whole sentence of a repeated passage goes, whatever the words of a single run."""

import re

import numpy as np

from gaplens.llm import sentence_spans

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?](?=\s)|[.!?\n]|\Z)\s*")


def slow_runs(rows, k, n_words):
    first, out = {}, {}
    parts = {i: [p for p in SENTENCE.findall(t) if p.strip()] for i, t in rows}
    words = {i: [tuple(p.lower().split()) for p in ps] for i, ps in parts.items()}
    runs = [(i, j, sum(words[i][j : j + k], ())) for i, _ in sorted(rows) for j in range(len(parts[i]) - k + 1)]
    for i, j, run in runs:
        first.setdefault(run, (i, j))
    for i, text in rows:
        copies = {j for at, j, run in runs if at == i and first[run] != (i, j)}
        gone = set()
        for j in copies:
            a = b = j
            while any(c in copies for c in range(a - k + 1, a)):
                a = min(c for c in range(a - k + 1, a) if c in copies)
            while any(c in copies for c in range(b + 1, b + k)):
                b = max(c for c in range(b + 1, b + k) if c in copies)
            if sum(len(w) for w in words[i][a : b + k]) >= n_words:
                gone |= set(range(a, b + k))
        out[i] = "".join(p for j, p in enumerate(parts[i]) if j not in gone)
    return out


def test_runs_match_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(rng.choice(["ab", "Cd", "e", "fgh"], rng.integers(1, 6))) + rng.choice([".", "!", "?"]) for _ in range(14)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.integers(1, 20)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, n_words in ((2, 7), (3, 12)):
        got = {r.doc_id: r.text for r in sentence_spans.dedup_runs(docs, min_sentences=k, min_words=n_words).collect()}
        assert got == slow_runs(rows, k, n_words)
    assert sentence_spans.dedup_runs(docs.limit(0)).count() == 0


def test_last_sentences_of_a_passage_go(spark):
    passage = "A b c d e f g h i j k l m. N o p q r s t u v w x y z. " + "The tail is short. It goes as well. "
    rows = [(1, passage + "First."), (2, "Other words here. " + passage + "Second end."), (3, "The tail is short. It goes as well. Third.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentence_spans.dedup_runs(docs).collect()}
    assert got == {1: rows[0][1], 2: "Other words here. Second end.", 3: rows[2][1]}
