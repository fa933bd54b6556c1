"""The ids of the n best segmentations, against exhaustive search."""

import hashlib

import numpy as np

from gaplens.llm.sentencepiece_nbest import MODEL_FILE, decode_column, encode_column, ids_digest, lattice, nbest_digest, pieces

TEXTS = ["the cat", "ab cd", "été", "日x a", None, "", "a thing"]


def every_path(edges, end):
    if end == 0:
        return [(0.0, ())]
    return [(p + score, ids + more) for start, score, more in edges[end] for p, ids in every_path(edges, start)]


def test_ids_of_the_n_best(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = pieces(MODEL_FILE)
    rows = encode_column(docs).withColumn("digest", nbest_digest()).collect()
    for row in rows:
        text = TEXTS[row.doc_id]
        got = [tuple(x) for x in row.nbest_ids]
        assert row.ids == row.nbest_ids[0] and len(got) == len(row.nbest_scores) == len(set(got))
        assert row.digest == hashlib.sha256("\n".join(" ".join(map(str, x)) for x in got).encode()).hexdigest()
        if not text:
            assert got == [()]
            continue
        unit = "▁" + text.replace(" ", "▁")
        every = sorted(every_path(lattice(model, unit), len(unit)), reverse=True)
        scores = {ids: score for score, ids in every}
        assert np.allclose([scores[x] for x in got], row.nbest_scores)
        assert np.allclose(row.nbest_scores, [s for s, _ in every[:4]]) and len(got) == min(4, len(every))


def test_every_segmentation_decodes_to_its_text(spark):
    texts = ["The quick brown fox jumps over the lazy dog. " * 20, "naïve 日本 text\n\nagain " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = encode_column(docs).selectExpr("doc_id", "explode(nbest_ids) as ids")
    assert [r.decoded for r in decode_column(flat).orderBy("doc_id").collect()] == [t for t in texts for _ in range(4)]


def test_digests_come_with_the_segmentations(spark):
    """Hashed where a text is segmented, they are those of the lists, which need not leave the task."""
    texts = [*TEXTS, "\u0394 \u65e5\u672c \U0001f600 x" * 3, "The quick brown fox jumps over the lazy dog. " * 20, " ", "a", "zz" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain = encode_column(docs).withColumn("a", ids_digest()).withColumn("b", nbest_digest()).orderBy("doc_id").collect()
    found = encode_column(docs, digest=True)
    assert "nbest_ids" not in found.columns
    assert [(r.ids, r.nbest_scores, r.ids_sha256, r.nbest_sha256) for r in found.orderBy("doc_id").collect()] == [(r.ids, r.nbest_scores, r.a, r.b) for r in plain]
