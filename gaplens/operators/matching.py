"""Vectors: clusters, nearest roadmap items, votes and their thresholds."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.functions.text import dot, unit

#: A block of items and a chunk of members take about this many bytes as a matrix; a chunk has ROWS members or more where there are tasks to spare.
BLOCK_BYTES = 16 << 20
ROWS = 4096
#: Similarities that a task holds at a time, whatever the sizes of its chunk and block.
CELLS = 1 << 20
#: A range of so many values is read whole by an exact percentile.
PERCENTILE_ROWS = 100_000


def _vectors(table: pa.Table, column: str = "embedding") -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)


def met(members: DataFrame, items: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows that `run` makes of every chunk of members (member_id, embedding, ...) and block of items (item_id, embedding): a nested loop of blocks.

    Both are dealt by hash, members once for each block and items once for each chunk; a task holds one of each, sorted by nothing,
    and `run` looks at CELLS of their pairs at a time.
    """
    given = items.where("embedding is not null").select("item_id", "embedding")
    asked = members.where("embedding is not null")
    n, width = given.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    m = asked.count()
    count = lambda rows: max(1, -(-rows * 8 * width // BLOCK_BYTES))
    spread = min(members.sparkSession.sparkContext.defaultParallelism, -(-m // ROWS))
    blocks, chunks = count(n), max(count(m), spread, 1)
    numbers = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = asked.withColumn("__chunk", F.pmod(F.xxhash64("member_id"), F.lit(chunks)).cast("int")).withColumn("__block", numbers(blocks))
    right = given.withColumn("__block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("__chunk", numbers(chunks))
    key = ("__block", "__chunk")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _tiles(members: pa.Table, matrix: np.ndarray):
    """(first member, last, similarities) of CELLS pairs at a time."""
    rows = max(1, CELLS // max(1, len(matrix)))
    for first in range(0, len(members) if len(matrix) else 0, rows):
        part = members.slice(first, rows)
        yield first, first + len(part), _vectors(part) @ matrix.T


def _nearest(k: int):
    """A chunk's k nearest items of a block; equal similarities (to 12 places) go to the least id."""

    def run(members: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("item_id")
        top = min(k, len(items))
        at, best = np.zeros((len(members), top), np.int64), np.zeros((len(members), top))
        for first, last, sims in _tiles(members, _vectors(items)) if top else ():
            keys, row = np.round(sims, 12), np.arange(last - first)
            for place in range(top):
                at[first:last, place] = keys.argmax(1)
                best[first:last, place] = sims[row, at[first:last, place]]
                keys[row, at[first:last, place]] = -np.inf
        rows = pa.array(np.repeat(np.arange(len(members) if top else 0), top))
        return pa.table([members["member_id"].take(rows), members["cluster_id"].take(rows), items["item_id"].take(pa.array(at.ravel())), pa.array(best.ravel())], names=["member_id", "cluster_id", "item_id", "sim"])

    return run


def nearest(members: DataFrame, items: DataFrame, k: int = 1) -> DataFrame:
    """(member_id, cluster_id, item_id, sim, place): the k items nearest to each member, by matrix products of blocks.

    Each block of items gives its k best; one aggregation by member keeps the best of those.
    """
    types = dict(members.dtypes)
    schema = f"member_id {types['member_id']}, cluster_id {types['cluster_id']}, item_id {dict(items.dtypes)['item_id']}, sim double"
    found = met(members.select("member_id", "cluster_id", "embedding"), items, _nearest(k), schema)
    best = F.struct((-F.round("sim", 12)).alias("s"), "item_id", "sim")
    if k == 1:
        return found.groupBy("member_id", "cluster_id").agg(F.min(best).alias("b")).select("member_id", "cluster_id", "b.item_id", "b.sim", F.lit(1).alias("place"))
    ranked = found.groupBy("member_id", "cluster_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("b"))  # k of each block
    return ranked.select("member_id", "cluster_id", F.posexplode("b").alias("at", "b")).select("member_id", "cluster_id", "b.item_id", "b.sim", (F.col("at") + 1).alias("place"))


def _beaten(members: pa.Table, items: pa.Table) -> pa.Table:
    """How many items of a block are nearer than each member's expected one, or as near with an id that is not greater."""
    items = items.sort_by("item_id")
    counts = np.zeros(len(members), np.int64)
    order = items["item_id"].to_pylist()
    aims = members["aim"].to_numpy()
    upto = np.array([bisect.bisect_right(order, x) for x in members["expected_id"].to_pylist()], np.int64)
    for first, last, sims in _tiles(members, _vectors(items)) if order else ():
        np.round(sims, 12, out=sims)
        aim = aims[first:last, None]
        counts[first:last] = (sims > aim).sum(1) + ((sims == aim) & (np.arange(len(order))[None, :] < upto[first:last, None])).sum(1)
    return pa.table([members["member_id"], members["expected_id"], pa.array(counts)], names=["member_id", "expected_id", "n"])


def expected_rank(members: DataFrame, items: DataFrame, expected: DataFrame) -> DataFrame:
    """(member_id, expected_id, place): how many items are nearer to a probe than the expected one, or as near with a lesser id, and one.

    A block of items answers with one count a probe, so no pair of a probe and an item leaves a task.
    """
    own = members.join(expected, "member_id").join(items.select(F.col("item_id").alias("expected_id"), F.col("embedding").alias("__e")), "expected_id")
    aim = own.select("member_id", "expected_id", F.col("embedding").cast("array<double>").alias("embedding"), F.round(dot(F.col("embedding"), F.col("__e")), 12).alias("aim"))
    types = dict(aim.dtypes)
    counts = met(aim, items, _beaten, f"member_id {types['member_id']}, expected_id {types['expected_id']}, n long")
    return counts.groupBy("member_id", "expected_id").agg(F.sum("n").alias("place"))


def top1(members: DataFrame, items: DataFrame) -> DataFrame:
    """The nearest item of each member, the least id on ties."""
    return nearest(members, items).drop("place")


def margins(members: DataFrame, items: DataFrame) -> DataFrame:
    """Best and second similarity of each member and their distance; a second is 0 where there is none."""
    found = nearest(members, items, 2).groupBy("member_id").agg(F.max(F.when(F.col("place") == 1, F.col("item_id"))).alias("item_id"), F.max(F.when(F.col("place") == 1, F.col("sim"))).alias("s1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("sim"))), F.lit(0.0)).alias("s2"))
    return found.select("member_id", "item_id", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"), F.round(F.col("s1") - F.col("s2"), 6).alias("margin"))


def agreement_floor(n):
    return F.when(n <= 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(0.3 * n).cast("int")))


def plurality(matches: DataFrame) -> DataFrame:
    """The item most members of a cluster chose, ties to the one chosen by the first member; and the runner-up in the same order.

    score: mean similarity of those who agree; member_mean: of all. `accepted` tells whether the votes reach the agreement floor;
    a null distribution uses the rows whatever it says.
    """
    votes = matches.groupBy("cluster_id", "item_id").agg(F.count("*").alias("votes"), F.min("member_id").alias("first"), F.avg("sim").alias("score"), F.sum("sim").alias("all"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "first", "item_id", "votes", "score")))  # at most one entry a member
    won = votes.groupBy("cluster_id").agg(order.alias("o"), F.sum("votes").alias("members"), F.sum("all").alias("all"))
    first, second = F.col("o")[0], F.try_element_at("o", F.lit(2))
    out = won.select(
        "cluster_id",
        "members",
        first["item_id"].alias("item_id"),
        first["votes"].alias("votes"),
        F.round(first["score"], 6).alias("score"),
        F.round(F.col("all") / F.col("members"), 6).alias("member_mean"),
        second["item_id"].alias("runner_up"),
        F.coalesce(second["votes"], F.lit(0)).alias("runner_up_votes"),
    )
    out = out.withColumn("agreement", F.round(F.col("votes") / F.col("members"), 6))
    return out.withColumn("accepted", F.col("votes") >= agreement_floor(F.col("members")))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster_id, size, centroid): the mean vector over its norm."""
    parts = members.select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # one entry a dimension
    return vectors.select("cluster_id", unit(F.col("v.x")).alias("centroid"))


def cluster_summary(members: DataFrame) -> DataFrame:
    """Size, cohesion, mean rating, spread and the most central member of each cluster."""
    near = members.join(centroids(members), "cluster_id").withColumn("sim", dot(F.col("embedding"), F.col("centroid")))
    return near.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.round(F.avg("sim"), 6).alias("cohesion"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.round(F.countDistinct("rating") / 5, 6).alias("rating_spread"),
        F.max_by("member_id", F.struct("sim", -F.col("member_id"))).alias("central_id"),
    )


def exact_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """The percentile by linear interpolation: passes over equal bins narrow the range until its values fit PERCENTILE_ROWS."""
    value = F.col(column).cast("double")
    n, low, high = df.where(value.isNotNull()).agg(F.count("*"), F.min(value), F.max(value)).first()
    if not n:
        return None
    rank, below = (n - 1) * p, 0
    inside = n
    while inside > PERCENTILE_ROWS and low < high:
        width = (high - low) / 1024
        bins = df.where(value.between(low, high)).groupBy(F.least(F.lit(1023), F.floor((value - low) / width)).alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        rows = bins.orderBy("b").collect()  # at most 1024
        upto = below
        for i, r in enumerate(rows):
            if upto + r["n"] > rank:
                last = rows[i + 1] if upto + r["n"] <= rank + 1 and i + 1 < len(rows) else r
                below, low, high = upto, r["low"], last["high"] if last is r else last["low"]
                break
            upto += r["n"]
        now = df.where(value.between(low, high)).count()
        if now == inside:
            break
        inside = now
    values = [r[0] for r in df.where(value.between(low, high)).groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy("v").selectExpr("struct(v, n) as s").collect()]  # different values of one range
    places, at = {}, below
    for r in values:
        for want in (int(rank), min(int(rank) + 1, n - 1)):
            if at <= want < at + r["n"]:
                places[want] = r["v"]
        at += r["n"]
    a, b = places[int(rank)], places[min(int(rank) + 1, n - 1)]
    return a + (b - a) * (rank - int(rank))


def null_threshold(scores: DataFrame, p: float = 0.95, floor: float = 0.16) -> float:
    """The percentile of control scores; a cluster without a match counts 0, no controls give the absolute floor."""
    found = exact_percentile(scores.select(F.coalesce("score", F.lit(0.0)).alias("score")), "score", p)
    return floor if found is None else found


def fire_rate(votes: DataFrame, group: Column, threshold: float) -> DataFrame:
    out = votes.groupBy(group.alias("kind")).agg(F.count("*").alias("clusters"), F.count_if(F.col("score") >= threshold).alias("fired"), F.round(F.avg("score"), 6).alias("mean_top1"))
    return out.withColumn("fire_rate", F.round(F.col("fired") / F.col("clusters"), 6))


def separation(rates: DataFrame, real: str = "real") -> DataFrame:
    """The real group's fire rate less the mean of the control groups' rates."""
    mean = lambda wanted: F.avg(F.when(wanted, F.col("fired") / F.col("clusters")))
    return rates.agg(F.round(mean(F.col("kind") == real) - mean(F.col("kind") != real), 6).alias("separation"))
