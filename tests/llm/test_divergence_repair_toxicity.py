"""Operators 11, 12 and 13 against plain versions, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaplens.llm import conversation_repair as cr
from gaplens.llm import source_divergence as sd
from gaplens.llm import toxic_passages as tp

SF = "/root/testdata/sf0.001"


def audited(rows, least, top=50):
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        sources[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        shares = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: shares(counts[lang, s]) for s in own}, shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", over)) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "dense", "slice_"), [(256, 4, 4096), (2, 1, 7), (3, 100, 5), (2, 0, 3)])
def test_divergence_in_tiles_and_postings(spark, monkeypatch, block, dense, slice_):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "DENSE", dense)
    monkeypatch.setattr(sd, "SLICE", slice_)
    random.seed(3)
    words = ["a", "Bé", "bé", "C", "dd", "É", "x1y", "日本", "zz"]
    rows = [(random.choice(["en", None, "fr"]), random.choice(["s1", "s2", None, "S", "é", "q"]), random.choice([None, "", "7", " ".join(random.choices(words, k=random.randrange(1, 9)))])) for _ in range(120)]
    rows += rows[:9] + [("xx", "only", "rare words"), ("xx", "none", None)]
    docs = spark.createDataFrame([(None, *r, 1, 2) for r in rows], "doc_id long, lang string, source string, text string, term int, value int")
    got = sorted(tuple(r) for r in sd.source_divergence(docs, least=5).collect())
    assert got == audited(rows, 5)
    assert {r[4] for r in got if r[0] == "xx"} == {0}


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert sd.source_divergence(docs).collect() == []


def repaired(rows):
    """Forward over the states, keeping (cost, audit) least of each."""
    talks = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            talks[c] += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    follows = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}
    out = []
    for c, said in talks.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, r, x in said:
            solid = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("b" if not solid else "d" if (r, x) in seen else "" if solid[-1] in ".!?" else "t")
            seen.add((r, x))

        def better(states, s, found):
            if s not in states or found[:2] < states[s][:2]:
                states[s] = found

        def inserted(states):
            for _ in range(3):
                for s in list(states):
                    for initial, name in names.items():
                        if (s, initial) in follows:
                            better(states, follows[s, initial], (states[s][0] + 3, states[s][1] + "I", [*states[s][2], f"{name}:"]))
            return states

        states = inserted({"n": (0, "", [])})
        for (_, r, x), fault in zip(said, faults, strict=True):
            after = {}
            for s, (cost, audit, text) in states.items():
                better(after, s, (cost + 4, audit + "D", text))
                if fault in ("b", "d"):
                    continue
                more = 3 if fault else 0
                if (s, r[:1]) in follows:
                    better(after, follows[s, r[:1]], (cost + more, audit + "K", [*text, f"{r}:{x}"]))
                for initial, name in names.items():
                    if (s, initial) in follows:
                        better(after, follows[s, initial], (cost + 3 + more, audit + "R", [*text, f"{name}:{x}"]))
            states = inserted(after)
        cost, audit, text = min((states[s] for s in "na" if s in states), key=lambda v: v[:2])
        turns = [t for t, *_ in said if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("longest", [4096, 7])
def test_repair_whole_and_in_segments(spark, longest):
    random.seed(5)
    texts, roles = ["Hi.", "no end", "", "  ", "Yes!", "a b?", None, "x\ny."], ["user", "assistant", "system", "tool", "", None, "u", "user", "assistant"]
    rows = [(c, random.choice([t, t, t, t + 3, None, 0]), random.choice(roles), random.choice(texts)) for c in [*range(60), None] for t in range(random.choice([0, 1, 2, 3, 5, 9]))]
    rows += [(777, t, random.choice(roles[:5]), random.choice(["A.", "B", "C! ", " ", f"{t}.", f"{t}"])) for t in range(60)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, code string").repartition(3)
    got = sorted((tuple(r) for r in cr.repair_conversations(df, longest=longest).collect()), key=str)
    assert got == repaired(rows)


def test_repair_of_nothing_and_of_dropped_talks(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert cr.repair_conversations(spark.createDataFrame([], kind)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    got = cr.repair_conversations(spark.createDataFrame([(gone, 1, "user", "Hi.")], kind)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", cr.EMPTY)]


@pytest.mark.parametrize("signs", ["", "x", "sua", "au", "UaX".lower(), "sAuoU", "oooo", "uuaaxS"])
def test_audit_is_least_of_all_edits(signs):
    """Every string of letters up to the answer's cost, by brute force."""
    cost, audit = cr.cheapest(signs)
    found = []

    def go(row, state, spent, letters):
        if spent > cost or len(letters) > len(audit) + 4:
            return
        if row == len(signs) and state in (cr.NOTHING, cr.ASSISTANT):
            found.append((spent, letters))
        go(row, cr.NEXT[state], spent + 3, letters + "I")
        if row < len(signs):
            go(row + 1, state, spent + 4, letters + "D")
            s = signs[row]
            if s != "x":
                more = 3 if s.isupper() else 0
                go(row + 1, cr.NEXT[state], spent + 3 + more, letters + "R")
                lead = cr.LEADS.get(s.lower())
                if lead and state in cr.BEFORE[lead]:
                    go(row + 1, lead, spent + more, letters + "K")

    go(0, cr.NOTHING, 0, "")
    assert min(found) == (cost, audit)


def test_stretches_by_brute_force():
    def cut(scores, a, b):
        sums = {(i, j): sum(scores[i:j]) for i in range(a, b) for j in range(i + 1, b + 1)}
        best = max(sums.values(), default=0)
        if best <= 0:
            return []
        i, j = min((k for k, v in sums.items() if v == best), key=lambda k: (k[1] - k[0], k))
        return [*cut(scores, a, i), (i, j, best), *cut(scores, j, b)]

    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 5, 9, 14] * 30:
        scores = rng.integers(-1000, 800, n) * 2 + 1  # ties between stretches are unlikely
        assert tp.maximal_stretches(scores) == cut(scores.tolist(), 0, n)
    rows = np.repeat(np.arange(6), [3, 0, 7, 1, 0, 5])
    scores = rng.integers(-50, 50, len(rows))
    best, count = tp.best_sums(scores, rows, 6)
    own = [scores[rows == r] for r in range(6)]
    assert best.tolist() == [max([0, *(int(s[i:j].sum()) for i in range(len(s)) for j in range(i + 1, len(s) + 1))]) for s in own]
    assert count.tolist() == [len(s) for s in own]


def test_weights_by_brute_force():
    from gaplens.llm import textvec as tv
    import pyarrow as pa

    ((_, body, offsets),) = tv.chunks(pa.array(["Idiots, idiotic ab", None, "x"]))
    _, _, rows, levels = tp.tokens(body, offsets)
    assert rows.tolist() == [0, 0, 0, 2]
    keys = {}
    for level, (has, hashes) in enumerate(levels):
        for t, h in zip(has, hashes, strict=True):
            keys[level, int(t)] = int(h)
    known = {keys[0, 0]: (9, 1), keys[2, 1]: (4, 0), keys[4, 0] if (4, 0) in keys else 0: (1, 0)}
    order = np.array(sorted(known), np.uint64)
    weights = tp.Weights(order, np.array([known[int(k)][0] for k in order], float), np.array([known[int(k)][1] for k in order], float), 0.1)
    want = []
    for t in range(4):
        share = 0.1
        for level in range(5):
            if keys.get((level, t)) in known:
                a, b = known[keys[level, t]]
                share = (a + tp.STRENGTH * share) / (a + b + tp.STRENGTH)
        want.append(round((np.log(share / (1 - share)) - np.log(0.1 / 0.9) - tp.COST) * tp.UNIT))
    assert tp.weigh(levels, 4, weights).tolist() == want
    assert want[0] > 0 > want[2]


def test_toxicity_held_out_and_spans(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = tp.score_toxicity(docs, labels)
    judged = found.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in judged}
    assert share[1] >= 0.6 and share[0] <= 0.05
    spans = found.where("predicted = 1 and size(passages) > 0").join(docs, "doc_id").select("text", "passages").collect()
    assert spans
    insults = ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron")
    inside = [r["text"][p["start"] : p["end"]].lower() for r in spans for p in r["passages"]]
    assert sum(any(w in x for w in insults) for x in inside) >= len(inside) / 2


def test_toxicity_defined_results(spark):
    docs = spark.createDataFrame([(i, t, 1.0, 2, [3]) for i, t in [(1, None), (2, ""), (2, "idiot"), (None, "fine"), (4, "Ä idiot " * 50_000), (5, "!!")]], "doc_id long, text string, score double, best_sum int, passages array<int>")
    one = spark.createDataFrame([(1, 1), (4, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = tp.score_toxicity(docs, one).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {1.0}
    none = tp.score_toxicity(docs, one.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)} and not any(r["passages"] for r in none)
    assert [r["held_out"] for r in none if r["doc_id"] is None] == [False]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in none if r["doc_id"] is not None)
    assert tp.score_toxicity(docs.limit(0), one).collect() == []
