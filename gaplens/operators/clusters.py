"""K-means over many groups, numbers of clusters and restarts at once, and the choice of the number.

All runs of all groups share each pass over the vectors: a task holds the centroids of
every run (a few MB, bounded by the parameters) and sends each run's sums. Starts are
k-means++ draws by races of hashes, the same for any partitioning; runs of a group and
restart share their first centroids. The cosine silhouette comes from sums of vectors by
cluster, so no pair of members is looked at.

Defined results: runs with more clusters than different vectors do not take part; an
emptied cluster keeps its centroid; equal scores go to the fewer clusters, equal costs
to the earlier restart; equal distances to the lesser label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.operators.blocks import partials, summed
from gaplens.sources.shared import settled

# Restarts and passes of a run.
RESTARTS = 10
PASSES = 300
#: A run ends when no centroid moves further than this.
STILL = 1e-6
ROWS = 2048


def adaptive_k_range(n: int) -> tuple[int, int]:
    """Least and greatest number of clusters tried for n reviews."""
    if n < 8:
        return 2, 2
    most = max(2, min(14, n // 4))
    return min(2 if n < 40 else 3 if n < 80 else 4, most), most


def min_cluster_size(n: int) -> int:
    return 3 if n < 40 else 4 if n < 90 else 5


def k_bounds(n: Column) -> tuple[Column, Column, Column]:
    """The same three numbers as expressions: least and greatest k, least size."""
    most = F.when(n < 8, 2).otherwise(F.greatest(F.lit(2), F.least(F.lit(14), F.floor(n / 4)))).cast("int")
    fewest = F.when(n < 40, 2).when(n < 80, 3).otherwise(4)
    return F.least(fewest, most).cast("int"), most, F.when(n < 40, 3).when(n < 90, 4).otherwise(5).cast("int")


def of_least_size(members: DataFrame) -> DataFrame:
    """Members (cluster_id, ...) of clusters that reach the least size for all members together."""
    total = members.agg(k_bounds(F.count("*"))[2].alias("__least"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("__n")).crossJoin(F.broadcast(total)).where(F.col("__n") >= F.col("__least"))  # one row
    return members.join(sizes.select("cluster_id"), "cluster_id", "left_semi")


@dataclass
class Run:
    """One run: a group's k clusters from one restart."""

    group: int
    k: int
    restart: int
    centroids: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = 0.0


@dataclass
class Choice:
    """What was found for a group: k, its silhouette (-1 without one), centroids and sizes."""

    k: int
    silhouette: float
    centroids: np.ndarray
    sizes: np.ndarray


_DRAWN = pa.schema([("g", pa.int64()), ("restart", pa.int64()), ("race", pa.float64()), ("hash", pa.int64()), ("x", pa.list_(pa.float64()))])


def draw(hashes: np.ndarray, restart: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes of keys, for a restart and a step."""
    x = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (restart * 64 + step + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def _split(batch: pa.RecordBatch):
    """(group, hashes, vectors) of the groups in a batch, ROWS at a time. Columns: group, hash, embedding."""
    for first in range(0, len(batch), ROWS):
        part = batch.slice(first, ROWS)
        group = part.column(0).to_numpy()
        x = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
        for g in np.unique(group):
            mine = group == g
            yield int(g), part.column(1).to_numpy()[mine].view(np.uint64), x[mine]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, to 12 places, so that ties are ties in any partitioning."""
    return np.round(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1), 0), 12)


def _starts(rows: DataFrame, most: dict[int, int], restarts: int) -> dict[tuple[int, int], np.ndarray]:
    """For each group and restart up to its greatest k points: the next is drawn by its squared distance to those before."""
    chosen: dict[tuple[int, int], np.ndarray] = {(g, r): np.zeros((0, 0)) for g in most for r in range(restarts)}
    ended: set[tuple[int, int]] = set()
    for step in range(max(most.values(), default=0)):
        open_ = {key: c for key, c in chosen.items() if key not in ended and step < most[key[0]]}
        if not open_:
            break

        def run(batches, open_=open_, step=step):
            best: dict[tuple[int, int], tuple] = {}
            for batch in batches:
                for g, hashes, x in _split(batch):
                    for (group, restart), points in open_.items():
                        if group != g:
                            continue
                        far = _distances(x, points).min(1) if len(points) else np.ones(len(x))
                        with np.errstate(divide="ignore"):
                            race = np.where(far > 0, -np.log(draw(hashes, restart, step)) / far, np.inf)
                        i = np.lexsort((hashes, race))[0]
                        if race[i] < np.inf and (g, restart) not in best or race[i] < np.inf and (race[i], hashes[i]) < best[g, restart][:2]:
                            best[g, restart] = (race[i], hashes[i], x[i])
            if best:
                yield pa.RecordBatch.from_pylist([{"g": g, "restart": r, "race": float(b[0]), "hash": int(b[1].view(np.int64)), "x": b[2].tolist()} for (g, r), b in best.items()], _DRAWN)

        first = rows.mapInArrow(run, "g long, restart long, race double, hash long, x array<double>").groupBy("g", "restart").agg(F.min_by("x", F.struct("race", F.col("hash").bitwiseXOR(F.lit(-(1 << 63))).alias("h"))).alias("x")).collect()  # one point a group and restart
        found = {(r["g"], r["restart"]): np.array(r["x"]) for r in first}
        for key in open_:
            if key in found:
                chosen[key] = np.vstack([chosen[key], found[key]]) if len(chosen[key]) else found[key][None, :]
            else:
                ended.add(key)  # no point is left that is none of those before
    return chosen


def _pass(rows: DataFrame, runs: list[Run]) -> None:
    """Counts, sums and cost of each run's clusters at its centroids; the centroids of a group's runs are one matrix."""
    of: dict[int, list[int]] = {}
    for i, r in enumerate(runs):
        of.setdefault(r.group, []).append(i)
    places = {g: np.cumsum([0, *(len(runs[i].centroids) for i in mine)]) for g, mine in of.items()}
    stacked = {g: np.concatenate([runs[i].centroids for i in mine]) for g, mine in of.items()}

    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for g, _, x in _split(batch):
                if g not in of:
                    continue
                at, far, every = places[g], _distances(x, stacked[g]), np.arange(len(x))
                hot, cost = np.zeros((len(stacked[g]), len(x))), np.zeros(len(of[g]))
                for j in range(len(of[g])):
                    label = at[j] + far[:, at[j] : at[j + 1]].argmin(1)
                    hot[label, every] = 1
                    cost[j] = far[every, label].sum()
                part = (hot @ x, hot.sum(1), cost)
                total[g] = tuple(a + b for a, b in zip(total[g], part, strict=True)) if g in total else part
        parts = {}
        for g, (sums, counts, cost) in total.items():
            for j, i in enumerate(of[g]):
                mine = slice(places[g][j], places[g][j + 1])
                parts[i] = np.concatenate([sums[mine].ravel(), counts[mine], cost[j : j + 1]])
        yield from partials(parts)

    found = summed(rows, run, 8 * sum(r.centroids.size + len(r.centroids) + 1 for r in runs))
    for i, r in enumerate(runs):
        k, width = r.centroids.shape
        r.sums, r.counts, r.cost = found[i][: k * width].reshape(k, width), found[i][k * width : -1], float(found[i][-1])


def fit(rows: DataFrame, ranges: dict[int, tuple[int, int]], restarts: int = RESTARTS) -> dict[tuple[int, int], Run]:
    """The best restart of each (group, k) of rows (group int, hash long, embedding): least cost, to 9 places."""
    starts = _starts(rows, {g: hi for g, (_, hi) in ranges.items()}, restarts)
    runs = [Run(g, k, r, starts[g, r][:k].copy()) for g, (lo, hi) in ranges.items() for k in range(lo, hi + 1) for r in range(restarts) if len(starts[g, r]) >= k]
    moving = runs
    for _ in range(PASSES):
        if not moving:
            break
        _pass(rows, moving)
        still = []
        for r in moving:
            fresh = np.where(r.counts[:, None] > 0, r.sums / np.maximum(r.counts, 1)[:, None], r.centroids)
            if np.abs(fresh - r.centroids).max() > STILL:
                still.append(r)
            r.centroids = fresh
        moving = still
    if runs:
        _pass(rows, runs)
    best: dict[tuple[int, int], Run] = {}
    for r in runs:
        at = (r.group, r.k)
        if at not in best or round(r.cost, 9) < round(best[at].cost, 9):
            best[at] = r
    return best


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def silhouettes(rows: DataFrame, runs: dict[tuple[int, int], Run]) -> dict[tuple[int, int], float]:
    """The mean cosine silhouette of each run, from the sums of its clusters' unit vectors; a zero vector is as far from all as can be."""
    keys = list(runs)
    if not keys:
        return {}
    of: dict[int, list] = {}
    for i, at in enumerate(keys):
        of.setdefault(at[0], []).append((i, runs[at]))

    def over(part):
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for g, _, x in _split(batch):
                    for i, r in of.get(g, ()):
                        found = part(i, r, _unit(x), _distances(x, r.centroids).argmin(1))
                        total[i] = total[i] + found if i in total else found
            yield from partials(total)

        return summed(rows, run)

    def gathered(i, r, x, label):
        hot = np.zeros((r.k, len(x)))
        hot[label, np.arange(len(x))] = 1
        return (hot @ x).ravel()

    sums = {i: s.reshape(runs[keys[i]].k, -1) for i, s in over(gathered).items()}

    def scored(i, r, x, label):
        every = np.arange(len(x))
        apart = r.counts[None, :] - x @ sums[i].T  # summed distances to each cluster's members, to itself included
        size = r.counts[label]
        own = (apart[every, label] - (1 - (x * x).sum(1))) / np.maximum(size - 1, 1)
        other = np.where(r.counts > 0, apart / np.maximum(r.counts, 1), np.inf)
        other[every, label] = np.inf
        near = other.min(1)
        top = np.maximum(own, near)
        return np.array([np.where((size > 1) & np.isfinite(near) & (top > 0), (near - own) / np.where(top > 0, top, 1), 0.0).sum()])

    return {keys[i]: float(s[0]) / max(1.0, float(runs[keys[i]].counts.sum())) for i, s in over(scored).items()}


def by_silhouette(rows: DataFrame, n: dict[int, int], restarts: int = RESTARTS) -> dict[int, Choice]:
    """Each group's clusters of greatest silhouette, the fewest on ties; one cluster where the group is under the least size."""
    ranges = {g: adaptive_k_range(m) for g, m in n.items() if m >= min_cluster_size(m)}
    best = fit(rows, ranges, restarts)
    score = silhouettes(rows, {at: r for at, r in best.items() if (r.counts > 0).sum() > 1})
    out: dict[int, Choice] = {}
    for g, (lo, _) in ranges.items():
        tried = sorted(((-round(s, 12), k) for (group, k), s in score.items() if group == g))
        out[g] = _chosen(best, g, tried[0][1] if tried else lo, -tried[0][0] if tried else -1.0)
    return out


def by_mean_size(rows: DataFrame, n: dict[int, int], restarts: int = RESTARTS) -> dict[int, Choice]:
    """Each control group's clusters of greatest mean size among those large enough, the fewest on ties; the least k if none is."""
    ranges = {g: adaptive_k_range(m) for g, m in n.items() if m >= min_cluster_size(m)}
    best = fit(rows, ranges, restarts)
    out: dict[int, Choice] = {}
    for g, (lo, _) in ranges.items():
        least, tried = min_cluster_size(n[g]), []
        for (group, k), r in sorted(best.items()):
            sizes = r.counts[r.counts > 0]
            if group == g and len(sizes) > 1 and sizes.max() >= least:
                tried.append((-float(sizes[sizes >= least].mean()), k))
        out[g] = _chosen(best, g, min(tried)[1] if tried else lo, -1.0)
    return out


def _chosen(best: dict[tuple[int, int], Run], g: int, k: int, silhouette: float) -> Choice:
    run = best.get((g, k))
    return Choice(k, silhouette, run.centroids, run.counts) if run is not None else Choice(k, silhouette, np.zeros((0, 0)), np.zeros(0))


def labelled(rows: DataFrame, choices: dict[int, Choice]) -> DataFrame:
    """rows (group, hash, embedding, ...) with the label of the nearest centroid of their group; 0 where it has none."""
    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches):
        for batch in batches:
            label = np.zeros(len(batch), np.int32)
            group = batch.column(0).to_numpy()
            for first in range(0, len(batch), ROWS):
                part = slice(first, first + ROWS)
                x = batch.column(2).slice(first, ROWS).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(group[part]), -1)
                for g in np.unique(group[part]):
                    found = choices.get(int(g))
                    if found is not None and len(found.centroids):
                        mine = group[part] == g
                        label[part][mine] = _distances(x[mine], found.centroids).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label)], names=[*batch.schema.names, "cluster_id"])

    return rows.mapInArrow(run, f"{kind}, cluster_id int")


def prepared(vectors: DataFrame, group: Column, key: str) -> tuple[DataFrame, dict[int, str], dict[int, int]]:
    """(rows (group, hash, embedding, key), name of each group number, size of each), written once; groups are few by contract.

    Vectors are worked out once, before their groups are asked for, and dealt evenly, as every pass reads all of them.
    """
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    named = settled(vectors.select(group.cast("string").alias("__g"), F.col("embedding").cast("array<double>").alias("embedding"), F.col(key).alias(key)).where("embedding is not null").repartition(spread))
    names = [r["__g"] for r in named.select("__g").distinct().orderBy("__g").collect()]
    number = F.lit(-1)
    for i, name in enumerate(names):
        number = F.when(F.col("__g").eqNullSafe(F.lit(name)), i).otherwise(number)
    rows = named.select(number.cast("int").alias("group"), F.xxhash64(key).alias("hash"), "embedding", key)
    n = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()}
    return rows, dict(enumerate(names)), n
