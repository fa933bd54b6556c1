import itertools
import re

import numpy as np
import pandas as pd
import sentencepiece

from gaplens.llm import raking, sentence_spans
from gaplens.llm.sentencepiece_nbest import MODEL_FILE, decode_column, encode_column, lattice, nbest, pieces

NASTY = [None, "", " ", "\n", "a", "a. b", "日本語 и é\x00\t\n" * 3, "x" * 3000, " lead", "trail ", "🙂🙃 ok", "don't stop\n\nnow  twice"]


def paths(edges, end):
    if end == 0:
        return [0.0]
    return [p + score for start, score, _ in edges[end] for p in paths(edges, start)]


def test_nbest_is_exhaustive_on_short_units():
    model = pieces(MODEL_FILE)
    for unit in ("▁the", "▁thing", "étion", "▁日x", "▁"):
        every = sorted(paths(lattice(model, unit), len(unit)), reverse=True)
        assert np.allclose([s for s, _ in nbest(model, unit, 4)], every[:4])


def test_round_trip_and_scores(spark):
    docs = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    out = {r.doc_id: r for r in decode_column(encode_column(docs)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    for i, text in enumerate(NASTY):
        assert out[i].decoded == (text or "")
        assert out[i].nbest_scores == sorted(out[i].nbest_scores, reverse=True)
        assert library.decode(out[i].ids) == (text or "")
    assert encode_column(docs.limit(0)).count() == 0


def test_whole_text_nbest_matches_exhaustive_search(spark):
    texts = ["the cat", "ab cd", "été"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pieces(MODEL_FILE)
    for row in encode_column(docs).collect():
        unit = "▁" + texts[row.doc_id].replace(" ", "▁")
        every = sorted(paths(lattice(model, unit), len(unit)), reverse=True)
        assert np.allclose(row.nbest_scores, every[: len(row.nbest_scores)])


WS = r"[\x20\x09-\x0D]"


def slow_sentences(text):
    """Sentences with the white space after them."""
    out, at = [], 0
    for m in re.finditer(rf"(?<=[.!?]){WS}+|{WS}*\n{WS}*", text):
        if re.search(rf"[^\x20\x09-\x0D]", text[at : m.start()]) and m.end() < len(text):
            out.append(text[at : m.end()])
            at = m.end()
    if re.search(r"[^\x20\x09-\x0D]", text[at:]):
        out.append(text[at:])
    return out


def slow_dedup(rows, k, n_words):
    seen, out = {}, {}
    for i, text in sorted(rows):
        parts = slow_sentences(text or "")
        words = [re.findall(r"[^\x20\x09-\x0D]+", p.lower()) for p in parts]
        gone = set()
        for j in range(len(parts)):
            for end in range(j + k, len(parts) + 1):
                run = tuple(itertools.chain(*words[j:end]))
                if len(run) >= n_words:
                    if seen.setdefault(run, (i, j)) != (i, j):
                        gone |= set(range(j, end))
                    break
        out[i] = "".join(p for j, p in enumerate(parts) if j not in gone) if gone else text
    return out


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(rng.choice(["ab", "Cd", "e,", "fgh"], rng.integers(1, 7))) + rng.choice([".", "!", "?", ""]) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) + str(rng.choice([" ", "\n", "  ", "\t"])) for _ in range(rng.integers(0, 25)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(NASTY)] + [(200, rows[3][1]), (201, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in sentence_spans.dedup_spans(docs, min_sentences=2, min_words=6).collect()}
    assert got == slow_dedup(rows, 2, 6)


def test_spans_edges(spark):
    passage = "One two three four five six seven. " * 2 + "Eight nine ten eleven twelve thirteen. And so on until we all have words enough."
    rows = [(None, passage, 1), (1, passage, 2), (1, passage, 2), (2, passage.upper(), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __lost_n int")
    out = sentence_spans.dedup_spans(docs).collect()
    assert sorted(r.text for r in out) == ["", passage, passage, passage]
    assert sentence_spans.dedup_spans(docs.limit(0)).count() == 0


def mixture(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(["w"] * int(rng.integers(1, 90))), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), str(rng.choice(["en", "de"], p=[0.8, 0.2]))) for i in range(900)]
    return rows + [(900, None, None, None), (901, "", "a", None)]


def test_raked_weights_meet_targets(spark):
    docs = spark.createDataFrame(mixture(spark), "doc_id long, text string, source string, lang string")
    out = raking.mix_weights(docs, keep=0.3).toPandas()
    assert len(out) == 902
    frame = out[out.n_tokens > 0]
    cells = frame.groupby(raking.DIMS).n_tokens.sum().astype(float)
    weight, total = cells.copy(), cells.sum()
    share = {d: (lambda s: s**raking.FLATTEN / (s**raking.FLATTEN).sum())(cells.groupby(level=d).sum()) for d in raking.DIMS}
    for _ in range(200):
        for d in raking.DIMS:
            weight = weight * (share[d] * total / weight.groupby(level=d).sum()).reindex(weight.index.get_level_values(d)).to_numpy()
    want = np.minimum(1, 0.3 * weight / cells)
    got = frame.groupby(raking.DIMS).p.first()
    if (want < 1).all():
        assert np.allclose(got, want.reindex(got.index), atol=1e-4)
    kept = (frame.p * frame.n_tokens).sum() / frame.n_tokens.sum()
    assert abs(kept - 0.3) < 1e-3


def test_mixing_edges(spark):
    docs = spark.createDataFrame(mixture(spark), "doc_id long, text string, source string, lang string").withColumn("tokens", raking.F.lit(1))
    weights = raking.mix_weights(docs).where("sampled").select("doc_id").toPandas().doc_id.sort_values().tolist()
    drawn = raking.mix_sources(docs.repartition(7))
    assert drawn.columns == docs.columns
    assert drawn.toPandas().doc_id.sort_values().tolist() == weights
    assert raking.mix_weights(docs.limit(0)).count() == 0
    only = raking.mix_weights(docs, targets={"source": {"a": 1.0}}).toPandas()
    assert (only[(only.source == "b") & (only.n_tokens > 0)].p == 0).all() and isinstance(only, pd.DataFrame)
