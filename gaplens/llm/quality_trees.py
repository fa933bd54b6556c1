"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5).

Every text becomes a row of FEATURES numbers by numpy over Arrow batches. Trees are
grown level by level from histograms of binned features under logistic loss and kept
as flat arrays (feature, threshold, value) of complete binary trees, so that scoring
walks all rows of a batch through a tree at once. Training sees at most
MAX_TRAINING labelled rows, those of least hash of their id, out of the ids whose
CRC-32 modulo 4 is not 2; the rest is held out. All rows are scored.

Defined results: null and empty texts have all statistics 0 and are scored like any
other; labels other than 0 and 1 are ignored, an id labelled both ways counts as 1;
without labels of both kinds every score is the share of ones (0.5 without labels);
a null id is no held-out row and no training row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches, saved, small
from gaplens.llm.quality_rules import text_stats

MAX_TRAINING = 100_000
ROUNDS = 80
DEPTH = 4
BINS = 64
RATE = 0.15
CUTOFF = 0.7
FEATURES = [
    "log_words", "word_chars", "symbols", "dup_lines", "repeats", "words_per_line", "digits", "uppers", "stops", "commas",
    "non_ascii", "letters", "short_words", "long_words", "capitals", "distinct", "urls", "quotes", "longest_word", "log_lines",
]


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_CLASSES = {
    "digits": _class(b"0123456789"), "uppers": _class(bytes(range(65, 91))), "stops": _class(b".!?"), "commas": _class(b",;"),
    "non_ascii": np.arange(256) > 127, "letters": _class(bytes([*range(65, 91), *range(97, 123)])), "urls": _class(b"/@=_{}"), "quotes": _class(b"\"'()[]"),
}


def features(texts: pa.Array) -> np.ndarray:
    """A float32 row of FEATURES for each text."""
    stats = text_stats(texts)
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    column = {name: i for i, name in enumerate(FEATURES)}
    words = np.maximum(stats["n_words"], 1)
    out[:, column["log_words"]] = np.log1p(stats["n_words"])
    out[:, column["word_chars"]] = stats["word_chars"] / words
    out[:, column["symbols"]] = stats["n_symbols"] / np.maximum(stats["word_chars"], 1)
    out[:, column["dup_lines"]] = stats["n_dup_lines"] / np.maximum(stats["n_word_lines"], 1)
    out[:, column["repeats"]] = stats["n_repeat_words"] / words
    out[:, column["words_per_line"]] = stats["n_words"] / np.maximum(stats["n_word_lines"], 1)
    out[:, column["log_lines"]] = np.log1p(stats["n_word_lines"])
    for first, body, offsets in tv.chunks(texts):
        n = len(offsets) - 1
        rows = slice(first, first + n)
        size = np.maximum(offsets[1:] - offsets[:-1], 1)
        for name, members in _CLASSES.items():
            count = np.concatenate([[0], np.cumsum(members[body])])
            out[rows, column[name]] = (count[offsets[1:]] - count[offsets[:-1]]) / size
        starts, ends, row = tv.word_spans(body, offsets)
        if not len(row):
            continue
        length = ends - starts
        total = np.maximum(np.bincount(row, minlength=n), 1)
        share = lambda mask, row=row, n=n, total=total: np.bincount(row, mask, n) / total
        out[rows, column["short_words"]] = share(length <= 3)
        out[rows, column["long_words"]] = share(length > 12)
        out[rows, column["capitals"]] = share(_CLASSES["uppers"][body[starts]])
        keys = tv.hashes(tv.LOWER[body], starts, ends) ^ tv.mix(row.astype(np.uint64), 51)
        once = np.zeros(len(keys), bool)
        once[np.unique(keys, return_index=True)[1]] = True
        out[rows, column["distinct"]] = share(once)
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        out[rows, column["longest_word"]] = longest
    return out


@dataclass
class Trees:
    """Complete binary trees in flat arrays: row t of each array is a tree; a row goes right where x > threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        every = np.arange(len(x))
        inner = (1 << DEPTH) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, min_rows: int = 5, l2: float = 1.0) -> Trees:
    inner, leaves, width = (1 << DEPTH) - 1, 1 << DEPTH, x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if share in (0.0, 1.0) or not len(y):
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    margin = np.full(len(y), base)
    features_, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(count, 1e-9)
            cut = np.full(count, -1)
            for j in range(width):
                at = local * BINS + binned[:, j]
                g, h, c = (np.bincount(at, w, count * BINS).reshape(count, BINS) for w in (grad, hess, None))
                gl, hl, cl = (a.cumsum(1) for a in (g, h, c))
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(cl < min_rows) | (ct - cl < min_rows)] = -1
                gain[:, len(edges[j]) :] = -1
                b = gain.argmax(1)
                top = gain[np.arange(count), b]
                better = top > best
                best[better], cut[better] = top[better], b[better]
                feature[first : first + count][better] = j
            for k in np.flatnonzero(cut >= 0):
                threshold[first + k] = edges[feature[first + k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        margin += value[leaf]
        features_.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features_), np.array(thresholds), np.array(values))


def _measured(batches):
    for batch in batches:
        x = features(batch.column(1).cast(pa.string()))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.record_batch([batch.column(0), flat], names=["row_id", "x"])


def _scored(trees: Trees):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(trees.score(x))], names=["row_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training: int = MAX_TRAINING) -> DataFrame:
    """id, held_out, score and predicted of every row of docs."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["row_id"]
    measured = saved(in_batches(rows, _measured, f"row_id {id_type}, x array<float>"))
    held = F.coalesce(F.crc32(F.col("row_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("row_id")).agg(F.max("quality").alias("y")).where(~held)
    chosen = known.orderBy(F.xxhash64("row_id"), "row_id").limit(max_training)
    sample = measured.join(small(chosen, 24), "row_id").groupBy("row_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    table = sample.toArrow().sort_by("row_id")  # at most max_training rows of len(FEATURES) numbers
    x = np.array(table["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)).astype(np.float32)
    trees = fit(x, np.array(table["y"], np.float64))
    out = in_batches(measured, _scored(trees), f"row_id {id_type}, score double").withColumn("score", F.round("score", 6))
    return out.select(F.col("row_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
