"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values (operator 13).

A token is a run of ASCII letters and non-ASCII bytes, A-Z lower-cased. Its log-odds of
toxic against clean documents come from a chain of Dirichlet priors: the share of toxic
documents among those with the token is drawn towards the share of its prefix of 7
bytes, that one's towards 6, 5 and 4 bytes, and the last towards the share of all
documents. A document counts a token once, so no single text makes a word toxic.
Weights are whole numbers (units of 1 / UNIT nats less a cost a token), so a text
scores the same on any machine.

The largest sum over a stretch of a text is found for all texts of a batch in one
linear scan; texts whose sum is significant then get all their maximal stretches
(Ruzzo and Tompa). The chance that a clean text of n tokens has a stretch of sum s is
1 - exp(-K n exp(-lambda s)), the Gumbel law of Karlin and Altschul; lambda and K are
fitted to the sums over the PEAKS quantile of clean training documents that had no part
in the weights they are scored with (two folds). A document's evidence is that of its
best stretch plus that of its other significant ones; a logistic curve fitted to the
folds makes its surprise, minus the logarithm of that chance, a score from 0 to 1.

Training sees at most MAX_TRAINING labelled rows, those of least hash of their id, out
of the ids whose CRC-32 modulo 5 is not 0; equal texts count once. The weights are
those tokens and prefixes that two or more toxic documents of the sample have, so their
number is bounded by the sample and not by the corpus. All rows are scored.

Defined results: null and empty texts have no token and evidence of their own length;
labels other than 0 and 1 are ignored, an id labelled both ways counts as 1; without
labels of both kinds every score is the share of ones (0.5 without labels); a null id
is neither held out nor training; repeated ids are scored row by row; input columns
other than the two named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches, released, saved, small

MAX_TRAINING = 100_000
#: Lengths in bytes of the prefixes a token falls back to; the token itself comes after them.
PREFIXES = (4, 5, 6, 7)
#: How many documents a prior weighs. This and COST are the least log loss of 12 pairs (4, 8, 12 by 1 to 2.5) on cross-fitted training rows of sf0.1; no held-out row had a part in it.
STRENGTH = 12.0
#: Weights are in 1 / UNIT nats; every token costs COST nats, which ends stretches without toxic tokens.
UNIT = 256
COST = 1.5
#: A stretch is significant if at most one clean text in SIGNIFICANT of its length has as good a one.
SIGNIFICANT = 20
CUTOFF = 0.5
#: The law is fitted to clean sums over this quantile; surprise counts up to MOST nats.
PEAKS = 0.9
MOST = 60.0
#: Rows of counts a task holds before it sends them.
HELD = 1 << 18
LEAST = float(-np.log(-np.log1p(-1.0 / SIGNIFICANT)))

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Weights:
    """Sorted token hashes with the share of toxic documents each one shows, and the share of all."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    base: float

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[place] == hashes, place, -1)


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts, ends and row of each token, and for each level of the chain (which tokens have it, their hashes)."""
    starts, ends, rows = tv.spans(_letter[body], offsets)
    lower = tv.LOWER[body]
    size = ends - starts
    levels = []
    for level, (above, most) in enumerate(zip((0, *PREFIXES), (*PREFIXES, None), strict=True)):
        has = np.flatnonzero(size > above)  # a shorter token is its own prefix: nothing is learnt twice
        cut = ends[has] if most is None else np.minimum(ends[has], starts[has] + most)
        levels.append((has, tv.hashes(lower, starts[has], cut, 100 + level)))
    return starts, ends, rows, levels


def weigh(levels: list[tuple[np.ndarray, np.ndarray]], n: int, weights: Weights) -> np.ndarray:
    """The weight of each of n tokens: its share's log-odds against the base, in whole units, less the cost."""
    share = np.full(n, weights.base)
    for has, hashes in levels:
        place = weights.at(hashes)
        known = place >= 0
        rows, at = has[known], place[known]
        a, b = weights.toxic[at], weights.clean[at]
        share[rows] = (a + STRENGTH * share[rows]) / (a + b + STRENGTH)
    odds = np.log(share / (1 - share)) - np.log(weights.base / (1 - weights.base))
    return np.round((odds - COST) * UNIT).astype(np.int64)


def best_sums(scores: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest sum over a stretch, number of tokens) of each of n rows; an empty stretch sums to 0. One scan for all rows."""
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1] + np.arange(n)  # a zero stands before each row's scores
    steps = np.zeros(len(scores) + n, np.int64)
    keep = np.ones(len(steps), bool)
    keep[first] = False
    steps[keep] = scores
    total = np.cumsum(steps)
    far = 2 * int(np.abs(scores).sum()) + 1
    row = np.repeat(np.arange(n), count + 1)
    total -= row * far  # each row lies below all before it, so the running least restarts with the row
    return np.maximum.reduceat(total - np.minimum.accumulate(total), first) if n else np.zeros(0, np.int64), count


def maximal_stretches(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, sum) of all maximal scoring stretches, in order: linear time, neighbours of one sign taken together."""
    if not len(scores):
        return []
    up = scores > 0
    heads = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    sums = np.add.reduceat(scores, heads)
    bounds = np.append(heads, len(scores))
    found: list[list[int]] = []  # [first, last, sum before, sum at end, place of the last one with a lesser sum before]
    total = 0
    for i, s in enumerate(sums.tolist()):
        if s <= 0:
            total += s
            continue
        now = [int(bounds[i]), int(bounds[i + 1]), total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Calibration:
    """The law of clean sums (lam a unit, log_k a token) and the logistic curve of the surprise."""

    lam: float
    log_k: float
    slope: float
    bend: float

    def evidence(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """lambda s - log(K n); a text without a positive stretch has none."""
        return np.where(sums > 0, self.lam * sums - np.log(np.maximum(n, 1)) - self.log_k, -MOST)

    def together(self, best: np.ndarray, n: np.ndarray, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Evidence of texts with their best sums and the sums of all their stretches (row of each): the best one's and the other significant ones'."""
        all_ = self.evidence(sums, n[rows])
        one = self.evidence(best, n)
        counted = np.bincount(rows, np.where(all_ >= LEAST, all_, 0.0), len(best))
        return one + np.maximum(0.0, counted - np.where(one >= LEAST, one, 0.0))

    def surprise(self, evidence: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the chance that a clean text has as much evidence."""
        rate = np.exp(-np.clip(evidence, -MOST, 700))
        return np.minimum(-np.log(np.maximum(-np.expm1(-rate), 1e-300)), MOST)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bend + self.slope * self.surprise(evidence), -40, 40)))


def fit_law(sums: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lam and log_k from peaks over a threshold: their excess is exponential, their number Poisson in the tokens read."""
    if not len(sums):
        return 1.0 / UNIT, 0.0
    over = np.quantile(sums, PEAKS, method="higher") if len(sums) > 1 else 0
    peaks = sums[sums > over]
    if not len(peaks):
        over, peaks = 0, sums[sums > 0]
    lam = 1.0 / max(float(np.mean(peaks - over)), 1.0) if len(peaks) else 1.0 / UNIT
    return lam, float(np.log(max(len(peaks), 0.5) / max(int(n.sum()), 1)) + lam * over)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton steps."""
    beta = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (p - y) + l2 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + (l2 + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 4.0 / size if size else 1.0)
        if size < 1e-10:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def _counted(wanted: np.ndarray | None):
    """Training rows (fold, y, text) to (key, fold, y, n): in how many texts of this task each token is; of the wanted ones only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            group = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(2) + batch.column(1).to_numpy().astype(np.uint64)
            for first, body, offsets in tv.chunks(batch.column(2)):
                _, _, rows, levels = tokens(body, offsets)
                for has, hashes in levels:
                    if wanted is not None and len(wanted):
                        place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                        known = wanted[place] == hashes
                        has, hashes = has[known], hashes[known]
                    pairs = np.unique(np.stack([hashes, rows[has].astype(np.uint64)], 1), axis=0) if len(has) else np.zeros((0, 2), np.uint64)
                    held.append(np.stack([pairs[:, 0], group[first + pairs[:, 1].astype(np.int64)]], 1))
                    size += len(pairs)
                if size >= HELD:
                    yield _sent(held)
                    held, size = [], 0
        if size:
            yield _sent(held)

    return run


def _sent(held: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(held), axis=0, return_counts=True)
    group = found[:, 1].astype(np.int64)
    return pa.record_batch([pa.array(found[:, 0].view(np.int64)), pa.array(group // 2), pa.array(group % 2), pa.array(n.astype(np.int64))], names=["key", "fold", "y", "n"])


def _measured(weights_of: list[Weights]):
    """Training rows (fold, y, text) to (y, best, n, sums): each is weighed by the other fold's weights; sums of its maximal stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(0).to_numpy()
            best, count = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            sums: list[list[int]] = [[] for _ in range(len(batch))]
            for first, body, offsets in tv.chunks(batch.column(2)):
                _, _, rows, levels = tokens(body, offsets)
                n = len(offsets) - 1
                bounds = tv.row_bounds(rows, n)
                for f, weights in enumerate(weights_of):
                    scores = weigh(levels, len(rows), weights)
                    found, size = best_sums(scores, rows, n)
                    for r in np.flatnonzero(fold[first : first + n] == f):
                        best[first + r], count[first + r] = found[r], size[r]
                        if found[r] > 0:
                            sums[first + r] = [s for _, _, s in maximal_stretches(scores[bounds[r] : bounds[r + 1]])]
            yield pa.record_batch([batch.column(1), pa.array(best), pa.array(count), pa.array(sums, pa.list_(pa.int64()))], names=["y", "best", "n", "sums"])

    return run


def _judged(weights: Weights, law: Calibration):
    """(row_id, text) to (row_id, best, n_tokens, passages, score): places are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body, offsets in tv.chunks(batch.column(1)):
                starts, ends, rows, levels = tokens(body, offsets)
                n = len(offsets) - 1
                scores = weigh(levels, len(rows), weights)
                best, count = best_sums(scores, rows, n)
                hot = np.flatnonzero(law.evidence(best, count) >= LEAST)
                bounds = tv.row_bounds(rows, n)
                points = tv.code_points(body) if len(hot) else None
                passages: list[list[dict]] = [[] for _ in range(n)]
                of, sums = [], []
                for r in hot:
                    a, base = bounds[r], points[offsets[r]]
                    for i, j, s in maximal_stretches(scores[a : bounds[r + 1]]):
                        e = float(law.evidence(np.array([s]), count[r : r + 1])[0])
                        of.append(r)
                        sums.append(s)
                        if e >= LEAST:
                            passages[r].append({"start": int(points[starts[a + i]] - base), "end": int(points[ends[a + j - 1]] - base), "sum": s, "evidence": round(e, 6)})
                evidence = law.together(best, count, np.array(of, np.int64), np.array(sums, np.int64))
                yield pa.record_batch(
                    [batch.column(0).slice(first, n), pa.array(best), pa.array(count.astype(np.int64)), pa.array(passages, PASSAGES), pa.array(np.round(law.score(evidence), 6))],
                    names=["row_id", "best_sum", "n_tokens", "passages", "score"],
                )

    return run


PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.int64()), ("evidence", pa.float64())]))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _arrays(counts: DataFrame) -> dict[str, np.ndarray]:
    table = counts.toArrow().sort_by("key")  # tokens of the bounded sample
    return {c: table[c].to_numpy() for c in table.column_names}


def learn(rows: DataFrame, labels: DataFrame, id_col: str, max_training: int = MAX_TRAINING) -> tuple[Weights, Calibration] | float:
    """Weights and calibration from the labelled rows (row_id, text) that are not held out; the share of ones if only one kind is there."""
    known = labels.select(F.col(id_col).alias("row_id"), F.col("toxic").alias("y")).where(F.col("y").isin(0, 1) & F.col("row_id").isNotNull())
    known = known.groupBy("row_id").agg(F.max("y").cast("long").alias("y")).where(~held_out(F.col("row_id")))
    chosen = known.orderBy(F.xxhash64("row_id"), "row_id").limit(max_training)
    drawn = rows.join(small(chosen, 24), "row_id").withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    fold = (F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") % 2).alias("fold")
    sample = saved(drawn.groupBy("digest").agg(F.max("y").alias("y"), F.first("text").alias("text")).select(fold, "y", "text"))
    n = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # four rows
    toxic, total = sum(v for (_, y), v in n.items() if y), sum(n.values())
    if not 0 < toxic < total:
        released(sample)
        return toxic / total if total else 0.5
    seen = in_batches(sample.where("y = 1").select("fold", "y", "text"), _counted(None), "key long, fold long, y long, n long")
    wanted = np.sort(_arrays(seen.groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2").select("key"))["key"].view(np.uint64))
    sums = [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n"))), F.lit(0)).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)]
    per = _arrays(in_batches(sample.select("fold", "y", "text"), _counted(wanted), "key long, fold long, y long, n long").groupBy("key").agg(*sums))
    keys = per["key"].view(np.uint64)
    order = np.argsort(keys)

    def of(folds: tuple[int, ...]) -> Weights:
        a, b = (sum(per[f"n{f}{y}"] for f in folds)[order].astype(float) for y in (1, 0))
        share = (sum(n.get((f, 1), 0) for f in folds) + 0.5) / (sum(n.get((f, y), 0) for f in folds for y in (0, 1)) + 1)
        return Weights(keys[order], a, b, float(share))

    found = in_batches(sample.select("fold", "y", "text"), _measured([of((1,)), of((0,))]), "y long, best long, n long, sums array<long>").toArrow()  # at most max_training rows
    y, best, size = (found[c].to_numpy() for c in ("y", "best", "n"))
    sums = found["sums"].combine_chunks()
    released(sample)
    law = Calibration(*fit_law(best[y == 0], size[y == 0]), 1.0, 0.0)
    evidence = law.together(best, size, np.repeat(np.arange(len(y)), sums.value_lengths().to_numpy()), sums.flatten().to_numpy())
    law.slope, law.bend = fit_logistic(law.surprise(evidence), y.astype(float))
    return of((0, 1)), law


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_training: int = MAX_TRAINING) -> DataFrame:
    """id, held_out, score, predicted, best_sum, n_tokens and the significant passages of every row of docs."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    learnt = learn(rows, labels, id_col, max_training)
    if isinstance(learnt, float):
        law, weights = Calibration(1.0 / UNIT, 0.0, 0.0, float(np.log(learnt / (1 - learnt))) if 0 < learnt < 1 else (40.0 if learnt else -40.0)), Weights(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.5)
    else:
        weights, law = learnt
    schema = f"row_id {dict(rows.dtypes)['row_id']}, best_sum long, n_tokens long, passages array<struct<start:long,end:long,sum:long,evidence:double>>, score double"
    out = in_batches(rows, _judged(weights, law), schema)
    return out.select(F.col("row_id").alias(id_col), held_out(F.col("row_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "best_sum", "n_tokens", "passages")
