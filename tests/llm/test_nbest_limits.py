"""Long runs, ties and other columns of the SentencePiece operator."""

import time

import numpy as np

from gaplens.llm import sentencepiece_nbest as sp


def test_long_runs_end_and_decode(spark):
    texts = ["a" * 60_000, "a" * 150_000, "ab" * 40_000, None]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, ids array<int>")
    began = time.time()
    out = sp.decode_column(sp.encode_column(docs)).orderBy("doc_id").collect()
    assert time.time() - began < 120
    assert [r.decoded for r in out] == [t or "" for t in texts]
    assert [r.lang for r in out] == ["x"] * 4 and set(out[0].asDict()) == {"doc_id", "lang", "ids", "nbest_scores", "nbest_ids", "decoded"}
    for r in out[:3]:
        assert len(set(map(tuple, r.nbest_ids))) == 4 and r.nbest_scores == sorted(r.nbest_scores, reverse=True)


def test_a_node_is_left_n_times_at_most():
    model = sp.pieces(sp.MODEL_FILE)
    began = time.time()
    found = sp.nbest(model, "a" * 20_000, 4)
    assert time.time() - began < 30 and len({ids for _, ids in found}) == 4
    assert [x for x, _ in found] == sorted((x for x, _ in found), reverse=True)


def test_order_of_equal_segmentations_is_fixed():
    model = sp.pieces(sp.MODEL_FILE)
    text = "aaaa bbbb aaaa bbbb " * 3
    one = sp.Encoder(model, 4).encode([text])[0]
    other = sp.Encoder(model, 4).encode(["bbbb some aaaa words", text, text])
    for ids, scores in other[1:]:
        assert scores == one[1] and all((a == b).all() for a, b in zip(ids, one[0], strict=True))


def test_a_cut_run_is_segmented_stretch_by_stretch(monkeypatch):
    monkeypatch.setattr(sp, "LONGEST_UNIT", 100)
    model = sp.pieces(sp.MODEL_FILE)
    ids, scores = sp.Encoder(model, 2).encode(["a" * 250 + " end"])[0]
    assert sp.Decoder(model).decode(ids[0]).decode() == "a" * 250 + " end"
    whole = sp.nbest(model, sp.SPACE + "a" * 99, 1)[0][0]
    assert scores[0] <= 0 and np.isclose(scores[0], whole + sp.nbest(model, "a" * 100, 1)[0][0] + sp.nbest(model, "a" * 51, 1)[0][0] + sum(sp.Encoder(model, 1).encode(["end"])[0][1]))
