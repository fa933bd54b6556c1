"""Source divergence audit: how far the word use of the sources of a language lies apart (operator 11).

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language
keeps the terms that at least LEAST_DOCS of its documents have; with V kept terms and N
occurrences of them a group (a source within a language, or the language itself) gives
a term p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)) parts of SCALE.

Two sources differ by the sum of |p - q| over all kept terms. It is found in two parts
that add up exactly. Terms that many groups have are laid out as dense numpy tiles, a
block of sources by a slice of terms. For all other terms only the sources that have
them are read: with z the p of an absent term, a term that a alone has changes the sum
by |p - z_b| - |z_a - z_b|, which sorted values and their running sums give for all b
at once; for each pair of entries of a term's (short) posting list the cross term
|p - q| - |p - z_b| - |z_a - q| + |z_a - z_b| is added. V * |z_a - z_b| stands for
everything that neither has.

Documents are counted in tasks and meet as sums, so a hot source or word is a few rows.
Work units are a pair of blocks of sources and a slice of the terms: bounded by
BLOCK and SLICE at any size. The number of pairs is that of the result.

Defined results: null text, lang and source are empty strings; every row of the input
is a document, repeated ids too; a source without terms takes part with p of absent
terms; without kept terms a pair's value is 0; equal values are ranked by item, which
is unique in its group; an empty table gives no rows. Columns other than lang, source
and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.llm.common import in_batches, saved, small

# Fixed values of the audit.
LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Sources of a block and terms of a slice: a tile is at most 2 * BLOCK by SLICE numbers.
BLOCK = 256
SLICE = 4096
#: A term is dense if so many times its sources are more than all sources: about where a pair of entries costs as much as the row of a tile.
DENSE = 4
#: (group, term) counts a task holds before it sends them, and bytes of the terms it has read for them.
HELD, HELD_BYTES = 400_000, 64 << 20
DOCS = 1 << 44

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed over what the task holds; a group also has a row without a term."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences, and documents times DOCS
    size = weight = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = held.setdefault((lang, source), {})
            own: dict[bytes, int] = {}
            for term in _TERM.findall(text.encode()):
                own[term] = own.get(term, 0) + 1
            if own:
                lower: dict[bytes, int] = {}
                for term, n in own.items():
                    term = term.lower()  # of bytes: A-Z only
                    lower[term] = lower.get(term, 0) + n
                before = len(terms)
                for term, n in lower.items():
                    terms[term] = terms.get(term, 0) + n + DOCS
                if len(terms) > before:
                    size += len(terms) - before
                    weight += sum(map(len, lower))
            if size >= HELD or weight >= HELD_BYTES:
                yield from _sent(held)
                held, size, weight = {}, 0, 0
    yield from _sent(held)


def _sent(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in held.items():
        n = len(terms) + 1
        yield pa.record_batch(
            [
                pa.array([lang] * n, pa.string()),
                pa.array([source] * n, pa.string()),
                pa.array([None, *(t.decode() for t in terms)], pa.string()),
                pa.array([0, *(x % DOCS for x in terms.values())], pa.int64()),
                pa.array([0, *(x // DOCS for x in terms.values())], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def _p(count: Column, total: Column, kept: Column, scale: int, smooth: int) -> Column:
    """Whole parts of scale, by division of whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + F.lit(smooth)) * F.lit(scale).cast("decimal(12,0)"), wide(total) + wide(kept) * F.lit(smooth))


def _tile(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Entries and groups of a unit to (lang, a, b, value): each pair of sources once, what the unit's terms add to it."""
    first, second, part = (int(groups[c].iloc[0]) for c in ("i", "j", "part"))
    left = np.sort(groups.source[groups.block == first].to_numpy())
    right = left if first == second else np.sort(groups.source[groups.block == second].to_numpy())
    names = left if first == second else np.concatenate([left, right])
    begin = 0 if first == second else len(left)  # where the second block's sources begin among the names
    order = {s: k for k, s in enumerate(names)}
    z = np.zeros(len(names), np.int64)
    z[groups.source.map(order).to_numpy()] = groups.z.to_numpy()
    gap = np.abs(z[: len(left), None] - z[None, begin:])
    total = gap * int(groups.kept.iloc[0]) if part == 0 else np.zeros_like(gap)
    if len(entries) and gap.size:
        who, dense, p = entries.source.map(order).to_numpy(), entries.dense.to_numpy(), entries.p.to_numpy()
        term = np.unique(entries.term.to_numpy(), return_inverse=True)[1]
        if dense.any():
            total += _dense(who[dense], np.unique(term[dense], return_inverse=True)[1], p[dense], z, begin, gap)
        if not dense.all():
            total += _sparse(who[~dense], term[~dense], p[~dense], z, begin, gap)
    a, b = np.triu_indices(len(left), 1) if first == second else (x.ravel() for x in np.indices(total.shape))
    return pd.DataFrame({"lang": groups.lang.iloc[0], "a": left[a], "b": right[b], "value": total[a, b]})


def _dense(who: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray, begin: int, gap: np.ndarray) -> np.ndarray:
    """Sums of |p - q| - |z_a - z_b| over the terms of a tile, all groups by all terms."""
    n = int(term.max()) + 1
    tile = np.repeat(z[:, None], n, 1)
    tile[who, term] = p
    return np.stack([np.abs(tile[begin:] - tile[k]).sum(1) for k in range(len(gap))]) - n * gap


def _sparse(who: np.ndarray, term: np.ndarray, p: np.ndarray, z: np.ndarray, begin: int, gap: np.ndarray) -> np.ndarray:
    """The same over terms of few groups: each entry against absent ones by running sums, then corrections for pairs of entries."""
    out = np.zeros(gap.shape, np.int64)
    rows, columns = gap.shape
    for k in range(rows):
        mine = np.sort(p[who == k])
        out[k] += _against(mine, z[begin:]) - len(mine) * gap[k]
    for k in range(columns):
        mine = np.sort(p[who == begin + k])
        out[:, k] += _against(mine, z[:rows]) - len(mine) * gap[:, k]
    order = np.lexsort((who, term))
    who, term, p = who[order], term[order], p[order]
    for step in range(1, len(term)):  # entries of a term so many places apart, until no term has as many
        x = np.flatnonzero(term[step:] == term[:-step])
        if not len(x):
            break
        for a, b in ((x, x + step), (x + step, x)) if not begin else ((x, x + step),):
            across = (who[a] < rows) & (who[b] >= begin)
            a, b = a[across], b[across]
            za, zb = z[who[a]], z[who[b]]
            np.add.at(out, (who[a], who[b] - begin), np.abs(p[a] - p[b]) - np.abs(p[a] - zb) - np.abs(za - p[b]) + np.abs(za - zb))
    return out


def _against(values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each z the sum of |v - z| over sorted values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(values, z)
    return z * at - upto[at] + (upto[-1] - upto[at]) - z * (len(values) - at)


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of the kept terms, and a row without a term for every group; written to the shared folder."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = in_batches(docs.select(text("lang"), text("source"), text("text")), _counted, "lang string, source string, term string, n long, docs long")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))  # a row a source: the texts are read once
    return saved(counts.withColumn("d", everywhere).where(F.col("term").isNull() | (F.col("d") >= least)).select("lang", "source", "term", "n"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, scale: int = SCALE, smooth: int = SMOOTH) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources by distance, and the terms each source uses above its language's share."""
    counts = term_counts(docs, least)
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept, "lang", "left").select("lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all"))
    langs = saved(langs)
    groups = saved(groups.join(small(langs, 64), "lang"))
    share = lambda count, of: _p(count, of, F.col("kept"), scale, smooth)
    entries = counts.where("term is not null").join(terms, ["lang", "term"]).join(small(groups, 96), ["lang", "source"])
    entries = entries.withColumn("p", share(F.col("n"), F.col("size")))

    over = entries.withColumn("value", F.col("p") - share(F.col("total"), F.col("all"))).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    by_term = over.select("lang", "source", "term", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    by_term = by_term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / BLOCK)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") / SLICE)).cast("long")
    # A block meets all blocks, the lesser one first; with one block there is one unit for each slice of terms.
    units = lambda df: df.withColumn("block", F.pmod(F.xxhash64("source"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = units(entries.withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), parts)).withColumn("dense", F.col("has") * DENSE > F.col("sources"))).select("lang", "i", "j", "part", "source", "term", "p", "dense")
    zero = share(F.lit(0).cast("long"), F.col("size"))
    sides = units(groups.withColumn("z", F.when(F.col("kept") > 0, zero).otherwise(0)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))).select("lang", "i", "j", "part", "source", "block", "z", "kept")
    key = ["lang", "i", "j", "part"]
    sums = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(_tile, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(far))
    return by_pair.unionByName(by_term)
