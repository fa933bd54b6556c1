"""Risk-controlled quality rules (operator 8).

Word and line statistics of whole texts feed simple rules ("reject if the statistic
reaches a cutoff"). Good labelled documents form groups: every stratum with enough of them
is one, and the strata with fewer are pooled into one more, since no cutoff could be
certified in them alone. For each group and rule, cutoffs are tested from lenient to
strict: a cutoff is certified while the exact binomial tail rejects "more than `risk` of
the group's good documents fall to it" at the rule's level. Levels start at
`error / (groups * rules)`; a rule certified down to its strictest cutoff hands its level on
to the others (step-down over the chains of fixed-sequence tests), until nothing changes.
Of the certified cutoffs the one that rejects most bad documents net of ten times the good
ones is used, the most lenient on ties. With probability `1 - error` no rule of any group
then rejects more than `risk` of the group's good documents; in the pooled group that holds
for its strata together. `labels_needed` tells how many good labels a certificate takes: 286
where none is lost, with risk 0.02, error 0.05, four strata and four rules.

Defined results: a null or empty text has no words and fails the base rule; a null
stratum is a stratum of its own; a stratum without labels has no cutoffs; labels other than 0 and 1, or null, are ignored and a
document labelled both ways counts as good; repeated ids are rows of their own.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches, saved, small

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MIN_WORDS = 50
RISK = 0.02
ERROR = 0.05
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines"]


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text."""
    parts: list[np.ndarray] = []
    for _, body, offsets in tv.chunks(texts):
        n = len(offsets) - 1
        starts, ends, rows = tv.word_spans(body, offsets)
        points = tv.code_points(body)
        out = np.zeros((6, n), np.int64)
        out[0] = np.bincount(rows, minlength=n)
        out[1] = np.bincount(rows, points[ends] - points[starts], n)
        symbols = np.concatenate([[0], np.cumsum(SYMBOLS[body])])
        out[2] = symbols[offsets[1:]] - symbols[offsets[:-1]]
        line_from, line_to, line_row = tv.line_spans(body, offsets)
        a, b = tv.stripped(body, line_from, line_to)
        full = b > a
        keys = tv.hashes(body, line_from, line_to)[full] ^ tv.mix(line_row[full].astype(np.uint64), 21)
        out[3] = np.bincount(line_row[full][~_first(keys)], minlength=n)
        out[5] = np.bincount(line_row[full], minlength=n)
        if len(rows) > 2:
            h = tv.hashes(body, starts, ends)
            at = np.flatnonzero(rows[:-2] == rows[2:])
            p = tv.powers(3)
            w = tv.mix(h[at] + h[at + 1] * p[1] + h[at + 2] * p[2], 22) ^ tv.mix(rows[at].astype(np.uint64), 23)
            again = at[_repeated(w)]
            covered = np.zeros(len(rows), bool)
            for j in range(3):
                covered[again + j] = True
            out[4] = np.bincount(rows[covered], minlength=n)
        parts.append(out)
    whole = np.concatenate(parts, 1) if parts else np.zeros((6, 0), np.int64)
    return dict(zip(STATS, whole, strict=True))


def _first(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def with_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """docs and a struct column __stats; every other column passes through."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            stats = text_stats(batch.column(at).cast(pa.string()))
            added = pa.StructArray.from_arrays([pa.array(stats[k]) for k in STATS], STATS)
            yield pa.record_batch([*batch.columns, added], names=[*batch.schema.names, "__stats"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__stats", T.StructType([T.StructField(k, T.LongType()) for k in STATS]))])
    return in_batches(docs, run, schema)


def rules(prefix: str = "") -> dict[str, Column]:
    """Whole-number statistics from 0 to 100; larger is worse."""
    share = lambda a, b, times=100: F.least(F.lit(100), F.coalesce(F.floor(times * F.col(prefix + a) / F.nullif(F.col(prefix + b), F.lit(0))), F.lit(0))).cast("int")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_word_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words", 1),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the regularised incomplete beta function by continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    x, a, b = 1 - p, float(n - k), float(k + 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d, out, m = 1.0, 1 - (a + b) * x / (a + 1), 0.0, 0
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    while m < 100_000:
        m += 1
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + e * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + e / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def labels_needed(risk: float, level: float) -> int:
    """The least number of good labels, none of them lost, that certifies a cutoff."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def certified(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> tuple[int | None, bool]:
    """The cutoff to use and whether every cutoff is certified, from counts of good and bad labelled documents by statistic (0 to 100)."""
    n, n_bad = int(good.sum()), int(bad.sum())
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, best_value = None, 0.0
    for cutoff in range(len(good) - 1, 0, -1):
        if not n or binomial_tail(int(lost[cutoff]), n, risk) > level:
            return best, False
        value = caught[cutoff] / max(n_bad, 1) - 10 * lost[cutoff] / n
        if value > best_value + 1e-12:
            best, best_value = cutoff, value
    return best, True


def certified_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    return certified(good, bad, risk, level)[0]


def learn_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str, risk: float, error: float) -> DataFrame:
    """(stratum, cutoffs map<rule, int>) from row_id, stratum and STATS of the labelled documents."""
    verdicts = labels.where(F.col("quality").isin(0, 1)).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("row_id")).agg(F.max("quality").alias("good"))
    named = rules()
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in named.items()]))
    counts = saved(
        stats.join(verdicts, "row_id")
        .where("n_words > 0")
        .select("stratum", "good", pairs.alias("r"))
        .groupBy("stratum", "r.rule", "r.value")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    strata = saved(counts.where(F.col("rule") == next(iter(named))).groupBy("stratum").agg(F.sum("good").alias("n_good")))
    needed = labels_needed(risk, error / max(1, strata.count() * len(named)))
    thick = F.col("n_good") >= needed
    groups = saved(strata.select("stratum", thick.alias("own"), F.when(thick, F.col("stratum")).otherwise("").alias("grp")))
    pooled = saved(counts.join(small(groups, 64), "stratum").groupBy("own", "grp", "rule", "value").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    chains, complete = groups.select("own", "grp").distinct().count() * len(named), 0
    while True:
        chosen = saved(_chosen(pooled, risk, error / max(1, chains - complete)))
        now = chosen.where("whole").count()
        if now in (complete, chains):
            break
        complete = now
    maps = chosen.where("cutoff is not null").groupBy("own", "grp").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # one entry a rule
    return groups.join(small(maps, 200), ["own", "grp"]).select("stratum", "cutoffs")


def _chosen(pooled: DataFrame, risk: float, level: float) -> DataFrame:
    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        good, bad = np.zeros(101, np.int64), np.zeros(101, np.int64)
        np.add.at(good, table["value"].to_numpy(), table["good"].to_numpy())
        np.add.at(bad, table["value"].to_numpy(), table["bad"].to_numpy())
        cutoff, whole = certified(good, bad, risk, level)
        columns = [pa.array([key[0].as_py()], pa.bool_()), *(pa.array([k.as_py()], pa.string()) for k in key[1:]), pa.array([cutoff], pa.int32()), pa.array([whole], pa.bool_())]
        return pa.table(columns, names=["own", "grp", "rule", "cutoff", "whole"])

    return pooled.groupBy("own", "grp", "rule").applyInArrow(choose, "own boolean, grp string, rule string, cutoff int, whole boolean")  # at most 101 rows a group


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, risk: float, error: float) -> tuple[DataFrame, DataFrame]:
    """The statistics of all rows without their texts, and the cutoffs of each stratum."""
    rows = docs.select(F.col(id_col).alias("row_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    stats = saved(with_stats(rows, "text").select("row_id", "stratum", "__stats.*"))
    cutoffs = saved(learn_cutoffs(stats, labels, id_col, risk, error))
    return stats, small(cutoffs, 200)


def _stratum(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _verdict(prefix: str = "") -> tuple[Column, Column]:
    n_words = F.col(f"{prefix}n_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n_words)
    kept = ~failed
    for name, value in rules(prefix).items():
        kept = kept & ~F.coalesce(value >= F.col("__cutoffs")[name], F.lit(False))
    return failed, kept


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """id, STATS, base_failed and kept for every row of docs."""
    stats, cutoffs = _learned(docs, labels, id_col, text_col, stratum_col, risk, error)
    failed, kept = _verdict()
    joined = stats.join(cutoffs.withColumnRenamed("cutoffs", "__cutoffs"), "stratum", "left")
    return joined.select(F.col("row_id").alias(id_col), *STATS, failed.alias("base_failed"), kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that the rules keep, judged row by row: texts are not shuffled."""
    _, cutoffs = _learned(docs, labels, id_col, text_col, stratum_col, risk, error)
    columns = docs.columns
    judged = with_stats(docs, text_col).withColumn("__stratum", _stratum(stratum_col))
    cutoffs = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    return judged.join(cutoffs, "__stratum", "left").where(_verdict("__stats.")[1]).select(columns)
