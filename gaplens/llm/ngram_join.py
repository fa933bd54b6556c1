"""Exact n-gram Jaccard join with count-vector R-trees (operator 4).

Shingles are hashed into groups. A document of n shingles can differ from a partner
at similarity s in at most d = floor((1 - s) / s * n) shingles, so of any d + 1 groups
that are not empty in it one holds the same shingles in both. Each text emits the
d + 1 of its groups whose contents are rarest in the corpus (a count sketch of fixed
size orders them; any order is exact). The size of the groups follows from the threshold,
so that a text has more than d of them; should one not have them, its size class is
signed anew with one shingle a group, which always suffices.

Texts that meet in an emitted group form a run. An R-tree over the vectors of group
counts joins each run: the sum of coordinate minima bounds the overlap with a node or a
text. Only the least number of pairs that hold a run's surviving texts together leave it, and
only texts in such a pair are read again for their shingles. Their clusters are joined by the
same R-tree, now with each surviving pair verified on the shingles; pairs already
connected are not compared. So a group of m near copies costs about m verifications.

Large groups. A key that many texts of one batch emit leaves one of them in the run and
links the others to it; so does a run beyond RUN texts, which is never held whole. Such
links only widen a cluster. A cluster beyond one block is joined block by block, then
again among the least members of its components as long as that halves them; what
still lies outside its largest component is then compared with all of the cluster in pairs
of blocks. A large group of near copies is one component by then and costs no pairs.

Defined results: a null, empty or wordless text has an empty set and links with nothing;
rows with one id share a component; a null id gets its text's component, null if it
has none; equal texts share a component through their digest, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.llm import textvec as tv
from gaplens.llm.common import components, in_batches, released, saved, small

SKETCH = 1 << 18
SLICES = 16
#: Up to this many shingles in a size class, each is a group of its own.
SINGLE = 48
BLOCK_SHINGLES = 500_000
BLOCK_DOCS = 512
#: Counts of a text: a power of two, this many shingles a count at most. The bound then stays sharp at any length.
DIMS = 64
PER_DIM = 16
LEAF = 24
#: A run of more texts is a star; a key of more texts in a batch sends one of them.
RUN = 512
BATCH_RUN = 64
#: A text with at least this share of all rows is hot: there are at most HOT of them.
HOT = 1000


def _class_bounds() -> np.ndarray:
    lo = [1]
    while lo[-1] < 1 << 40:
        lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
    return np.array(lo, np.int64)


CLASSES = _class_bounds()


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for _, body, offsets in tv.chunks(texts):
        body = tv.LOWER[body]
        starts, ends, rows = tv.word_spans(body, offsets)
        words = tv.hashes(body, starts, ends)
        bounds = tv.row_bounds(rows, len(offsets) - 1)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s = tv.shingles(words[a:b], k)
            s.sort()
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def most_differences(n: int, threshold: Fraction) -> int:
    return int((1 - threshold) * int(n / threshold))


def group_size(threshold: Fraction) -> float:
    """Shingles a group, so that the groups in use are 1.3 times the most differences; 0: one shingle a group."""
    most = 1.3 * float((1 - threshold) / threshold)
    return max((g / 10 for g in range(15, 60) if (1 - math.exp(-g / 10)) / (g / 10) >= most), default=0.0)


def group_keys(s: np.ndarray, size_class: int, size: float) -> np.ndarray:
    """One key for each group that is not empty: its number, its contents and the size class."""
    top = int(CLASSES[size_class + 1])
    if top <= SINGLE or not size:
        return tv.mix(s + np.uint64(size_class), 5)
    n_groups = int(top / size)
    g = ((s >> np.uint64(32)) * np.uint64(n_groups)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return tv.mix(np.add.reduceat(tv.mix(s, 3), first) + g[first] * np.uint64(1000003) + np.uint64(size_class), 4)


def _classes(n: int, threshold: Fraction) -> list[int]:
    at = np.searchsorted(CLASSES, [n, int(n / threshold)], "right") - 1
    return sorted(set(at.tolist()))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(40)).astype(np.int64) % SKETCH


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("vector", pa.binary()), ("thin", pa.int32())])
SIGNED_SQL = "doc_id long, n long, d1 long, d2 long, keys array<long>, vector binary, thin int"


def _signatures(k: int, threshold: Fraction, singles: frozenset[int]):
    """Rows of documents, and of each task's slices of the count sketch. The classes in `singles` have one shingle a group.

    The keys themselves are not among the rows: they take more room than the texts, which `_emitted` reads again.
    """
    size = group_size(threshold)

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        seen: dict[tuple[int, int], bool] = {}
        for batch in batches:
            n, d1, d2, vectors, thin = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                a, b = (int(tv.mix(s, x).sum(dtype=np.uint64)) if len(s) else 0 for x in (11, 12))
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                vectors.append(None)
                thin.append(None)
                if not len(s) or (a, b) in seen or not most_differences(len(s), threshold):
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen[a, b] = True
                classes = _classes(len(s), threshold)
                parts = [group_keys(s, c, 0 if c in singles else size) for c in classes]
                least = min(len(s), most_differences(len(s), threshold) + 1)
                thin[-1] = next((c for c, x in zip(classes, parts, strict=True) if len(x) < least), None)
                for x in parts:
                    np.add.at(sketch, _slot(x), 1)
                vectors[-1] = count_vector(s, n_dims(len(s))).astype("<u4").tobytes()
            digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d1, d2)]
            columns = [batch.column(0), pa.array(n, pa.int64()), *digests, pa.nulls(len(n), SIGNED.field("keys").type), pa.array(vectors, pa.binary()), pa.array(thin, pa.int32())]
            yield pa.record_batch(columns, schema=SIGNED)
        if sketch.any():
            width = SKETCH // SLICES
            for i in range(SLICES):
                row = (None, -1 - i, 0, 0, sketch[i * width : (i + 1) * width], None, None)
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, SIGNED.types, strict=True)], schema=SIGNED)

    return run


def _emitted(sketch: np.ndarray, k: int, threshold: Fraction, singles: frozenset[int]):
    """(key, text, head) of the d + 1 rarest groups of each text and class. With a head it is a link, dealt out by a key of its own."""
    size = group_size(threshold)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, docs = [], []
            for s in shingle_sets(batch.column(0), k):
                most = most_differences(len(s), threshold) + 1
                if not len(s) or most == 1:
                    continue
                own = tuple(int(tv.mix(s, x).sum(dtype=np.uint64)) for x in (11, 12))
                if own in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(own)
                for c in _classes(len(s), threshold):
                    part = group_keys(s, c, 0 if c in singles else size)
                    took = part[np.lexsort((part, sketch[_slot(part)]))[:most]] if len(part) > most else part
                    keys.append(took)
                    docs.append(np.full(len(took), own[0], np.uint64))
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs).view(np.int64)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(first, len(key)))
            head = np.repeat(doc[first], sizes)
            link = np.repeat(sizes > BATCH_RUN, sizes)
            link[first] = False
            yield pa.record_batch([pa.array(key[~link].view(np.int64)), pa.array(doc[~link]), pa.nulls(int((~link).sum()), pa.int64())], names=["key", "text", "head"])
            if link.any():
                pairs = np.unique(np.stack([doc[link], head[link]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                own_keys = tv.mix(pairs[:, 0].copy().view(np.uint64), 6).view(np.int64)
                yield pa.record_batch([pa.array(own_keys), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["key", "text", "head"])

    return run


def _runs(batches):
    """(run, text, head) from emitted rows in the order of key, head and text: the texts of each run of 2 to RUN texts,
    named by its members, so that equal runs have one name; links to the first text of longer ones."""
    key, held, length = None, np.zeros(0, np.int64), 0

    def links(docs, heads):
        return pa.record_batch([pa.nulls(len(docs), pa.int64()), pa.array(docs), pa.array(heads)], names=["run", "text", "head"])

    for batch in batches:
        keys, docs, heads = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        ready = heads.is_valid().to_numpy(zero_copy_only=False)
        if ready.any():
            yield links(docs[ready], heads.drop_null().to_numpy())
            keys, docs = keys[~ready], docs[~ready]
        if not len(keys):
            continue
        if key == keys[0] and length > RUN:  # only the head of the long run is held
            end = int(np.searchsorted(keys != key, True)) if (keys != key).any() else len(keys)
            rest = docs[:end][docs[:end] != held[0]]
            if len(rest):
                yield links(rest, np.full(len(rest), held[0]))
            keys, docs = keys[end:], docs[end:]
            if not len(keys):
                continue
        elif len(held) and length <= RUN:
            keys, docs = np.concatenate([np.full(len(held), key), keys]), np.concatenate([held, docs])
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, docs = keys[fresh], docs[fresh]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        key, held = keys[-1], docs[first[-1] :]
        length = len(held)
        bounds = np.append(first, len(keys))
        size = np.diff(bounds)
        last = np.zeros(len(size), bool)
        last[-1] = True
        for i in np.flatnonzero(size > RUN):
            members = docs[bounds[i] + 1 : bounds[i + 1]]
            yield links(members, np.full(len(members), docs[bounds[i]]))
        if length > RUN:
            held = held[:1]
        yield from _named(docs, bounds[:-1], size, (size > 1) & (size <= RUN) & ~last)
    if 1 < length <= RUN:
        yield from _named(held, np.array([0]), np.array([length]), np.array([True]))


def _named(docs: np.ndarray, first: np.ndarray, size: np.ndarray, wanted: np.ndarray):
    if not wanted.any():
        return
    name = tv.mix(np.add.reduceat(tv.mix(docs.view(np.uint64), 7), first) + size.astype(np.uint64), 8)
    at = np.flatnonzero(wanted)
    at = at[np.unique(name[at], return_index=True)[1]]
    name, first, size = name[at], first[at], size[at]
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    yield pa.record_batch([pa.array(np.repeat(name, size).view(np.int64)), pa.array(docs[take]), pa.nulls(len(take), pa.int64())], names=["run", "text", "head"])


class RTree:
    """A packed two-level R-tree over count vectors of documents sorted by size."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        busiest = counts.argmax(1) if len(counts) else np.zeros(0, int)
        band = np.searchsorted(CLASSES, sizes, "right")
        self.order = np.lexsort((counts[np.arange(len(counts)), busiest], busiest, band))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        first = np.arange(0, len(counts), LEAF)
        self.high = np.maximum.reduceat(self.counts, first) if len(first) else counts
        self.least = np.minimum.reduceat(self.sizes, first) if len(first) else sizes
        self.most = np.maximum.reduceat(self.sizes, first) if len(first) else sizes
        self.first = first

    def near(self, vector: np.ndarray, n: int, threshold: Fraction, wanted: np.ndarray, node_wanted: np.ndarray) -> np.ndarray:
        """Positions (in tree order) whose overlap bound reaches the threshold; `wanted` leaves out others."""
        p, q = threshold.numerator, threshold.denominator
        ok = node_wanted & (q * self.most >= p * n) & (q * n >= p * self.least)
        nodes = np.flatnonzero(ok)
        bound = np.minimum(self.high[nodes], vector).sum(1)
        nodes = nodes[(p + q) * bound >= p * (n + self.least[nodes])]
        if not len(nodes):
            return nodes
        at = (self.first[nodes][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        at = at[wanted[at]]
        bound = np.minimum(self.counts[at], vector).sum(1)
        at, bound = at[(p + q) * bound >= p * (n + self.sizes[at])], bound[(p + q) * bound >= p * (n + self.sizes[at])]
        return at[np.argsort(-bound, kind="stable")]


def n_dims(n: int) -> int:
    return 1 << max(DIMS - 1, -(-n // PER_DIM) - 1).bit_length()


def count_vector(s: np.ndarray, dims: int) -> np.ndarray:
    return np.bincount((s & np.uint64(dims - 1)).astype(np.int64), minlength=dims)


def folded(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Count vectors at a lower number of dims: counts whose shingles then share a number add up."""
    return np.stack([v.reshape(-1, dims).sum(0) for v in vectors])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def forest(sizes: np.ndarray, counts: np.ndarray, threshold: Fraction, holds=None, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (positions) that connect the points as all pairs would whose bound reaches the threshold and that `holds`.

    label: components known before. side: 0 or 1; where both occur, only pairs between the sides are sought.
    """
    m = len(sizes)
    tree = RTree(counts, sizes)
    order = tree.order
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1][order]
    members: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(i)
    tree_side = side[order] if side is not None and len(np.unique(side)) > 1 else None
    node_of = np.arange(m) // LEAF
    nodes = np.arange(len(tree.first))
    whole = np.array([label[a] if (label[a : a + LEAF] == label[a]).all() else -1 for a in tree.first])  # a node's component where all share one
    links = []
    for i in range(m):
        wanted = label != label[i]
        if tree_side is not None:
            wanted &= tree_side != tree_side[i]
        wanted[:i] = False
        for j in tree.near(tree.counts[i], int(tree.sizes[i]), threshold, wanted, (whole != label[i]) & (nodes >= node_of[i])):
            if label[j] == label[i] or not (holds is None or holds(order[i], order[j])):
                continue
            links.append((int(order[i]), int(order[j])))
            keep, gone = (label[i], label[j]) if len(members[label[i]]) >= len(members[label[j]]) else (label[j], label[i])
            moved = members.pop(gone)
            members[keep] += moved
            label[moved] = keep
            for node in {int(node_of[x]) for x in moved}:
                part = label[tree.first[node] : tree.first[node] + LEAF]
                whole[node] = keep if (part == keep).all() else -1
    return links


def _pairs(threshold: Fraction):
    """(src, dst) that hold the surviving texts of each run together; rows (run, doc_id, n, vector) come by run and doc_id."""
    p, q = threshold.numerator, threshold.denominator

    def joined(rows):
        """Links of whole runs. Texts of one number of dims are held against each other at it, others at the lower one."""
        run, docs, sizes, vectors = rows
        bounds = np.append(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), len(run))
        width = np.array([len(v) for v in vectors])
        found = [np.zeros((0, 2), np.int64)]
        two = bounds[:-1][np.diff(bounds) == 2]
        for dims in np.unique(np.minimum(width[two], width[two + 1])) if len(two) else ():
            at = two[np.minimum(width[two], width[two + 1]) == dims]
            least = np.minimum(folded([vectors[i] for i in at], dims), folded([vectors[i + 1] for i in at], dims)).sum(1)
            at = at[(p + q) * least >= p * (sizes[at] + sizes[at + 1])]
            found.append(np.stack([docs[at], docs[at + 1]], 1))
        for i in np.flatnonzero(np.diff(bounds) > 2):
            a, b = bounds[i], bounds[i + 1]
            links = forest(sizes[a:b], folded(vectors[a:b], int(width[a:b].min())), threshold)
            if links:
                found.append(docs[a:b][np.array(links)])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    def run(batches):
        held: list = [np.zeros(0, np.int64)] * 3 + [[]]
        for batch in batches:
            if not len(batch):
                continue
            vectors = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column(3)]
            now = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held[:3])] + [held[3] + vectors]
            cut = len(now[0]) - int((now[0] == now[0][-1]).sum())  # the last run may go on
            if cut:
                yield joined([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if len(held[0]):
            yield joined(held)

    return run


def _blocks(threshold: Fraction, k: int):
    """Rows (cluster, a, b, side, label, doc_id, text) sorted by block, in; links, out. Texts take less room on disk than their shingles."""
    p, q = threshold.numerator, threshold.denominator

    def done(rows, sets):
        sizes = np.array([len(s) for s in sets], np.int64)

        def holds(i, j):
            return (p + q) * overlap(sets[i], sets[j]) >= p * (len(sets[i]) + len(sets[j]))

        side, label, ids = (np.array(x) for x in list(zip(*rows, strict=True))[3:6])
        dims = n_dims(int(sizes.max()))
        found = forest(sizes, np.stack([count_vector(s, dims) for s in sets]), threshold, holds, label, side)
        if found:
            x, y = zip(*found, strict=True)
            yield pa.record_batch([pa.array(ids[list(x)]), pa.array(ids[list(y)])], names=["src", "dst"])

    def run(batches):
        rows, sets = [], []
        for batch in batches:
            for row, s in zip(zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True), shingle_sets(batch.column(6), k), strict=True):
                if rows and row[:3] != rows[-1][:3]:
                    yield from done(rows, sets)
                    rows, sets = [], []
                rows.append(row)
                sets.append(s)
        if rows:
            yield from done(rows, sets)

    return run


def _sized(k: int):
    def run(batches):
        for batch in batches:
            n = pa.array([len(s) for s in shingle_sets(batch.column(2), k)], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), n, batch.column(2)], names=["doc_id", "cluster", "n", "text"])

    return run


def _n_blocks(n: str = "n") -> Column:
    return F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_DOCS), F.sum(n) / F.lit(BLOCK_SHINGLES))).cast("int").alias("k")


def _part(k: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(k)).cast("int")


def linked(sets: DataFrame, threshold: Fraction, shingle: int) -> DataFrame:
    """Links (src, dst) that connect the documents of each cluster as all its links would; sets: (doc_id, cluster, n, text)."""

    def joined(placed: DataFrame) -> DataFrame:
        block = ["cluster", "a", "b"]
        rows = placed.select(*block, "side", "label", "doc_id", "text").repartition(*block).sortWithinPartitions(*block, "side", "doc_id")
        return saved(in_batches(rows, _blocks(threshold, shingle), "src long, dst long"))

    def single(rows: DataFrame, part: Column) -> DataFrame:
        return rows.select("cluster", part.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), F.col("doc_id").alias("label"), "doc_id", "text")

    large = saved(sets.groupBy("cluster").agg(_n_blocks()).where("k > 1"))
    n_large = large.count()
    found = joined(single(sets.join(small(large, 16, n_large), "cluster", "left").withColumn("k", F.coalesce("k", F.lit(1))), _part("k")))
    if not n_large:
        return found
    rows = sets.join(small(large, 16, n_large), "cluster")
    before, level, labelled = rows.count(), 0, None
    while True:
        names = components(found)
        released(labelled)
        labelled = saved(rows.join(names, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).select(*rows.columns, "label"))
        heads = labelled.where("doc_id = label")
        n, level = heads.count(), level + 1
        if 2 * n > before:
            break
        before = n
        again = heads.join(small(heads.groupBy("cluster").agg(_n_blocks().alias("kh")), 16, n_large), "cluster")
        more = joined(single(again, _part("kh", level)))
        if not more.limit(1).count():
            break
        found = saved(found.union(more))
    # What is outside its cluster's largest component against all of the cluster: side 0 holds all, side 1 the rest.
    sizes = labelled.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    whole = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_rows = labelled.join(small(whole, 16, n_large), "cluster")
    rest = open_rows.where("label <> most")
    kinds = saved(rest.groupBy("cluster").agg(_n_blocks().alias("kr")))
    placed = open_rows.join(small(kinds, 16, n_large), "cluster")
    all_of = placed.withColumn("a", _part("k")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("kr") - 1))).withColumn("side", F.lit(0))
    others = placed.where("label <> most").withColumn("b", _part("kr")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("side", F.lit(1))
    return found.union(joined(all_of.unionByName(others)))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; see the module's text.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    threshold = Fraction(percent, 100)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    thin: frozenset[int] = frozenset()
    while True:
        signed = saved(in_batches(docs, _signatures(shingle, threshold, thin), SIGNED_SQL))
        more = {r["thin"] for r in signed.where("thin is not null").select("thin").distinct().collect()}  # at most one row a size class
        if not more:
            break
        released(signed)
        thin |= more
    sketch = np.zeros(SKETCH, np.int64)
    width = SKETCH // SLICES
    slices = signed.where("n < 0").select("n", F.posexplode("keys").alias("i", "c")).groupBy("n", "i").agg(F.sum("c").alias("c")).where("c > 0")
    n, i, c = (x.to_numpy() for x in slices.toArrow().columns)  # SKETCH numbers in all, as Arrow: rows of Python would take tens of MB
    sketch[(-1 - n) * width + i] = c
    rows = signed.where("n >= 0").select("doc_id", "n", "d1", "d2")
    texts = saved(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("vector").alias("vector")))
    # d1 stands for the text up to here; should two texts share one, both come back from the join.
    emitted = in_batches(docs.select("text"), _emitted(sketch, shingle, threshold, thin), "key long, text long, head long")
    dealt = emitted.repartition("key").sortWithinPartitions("key", "head", "text")
    runs = saved(in_batches(dealt, _runs, "run long, text long, head long"))
    named = texts.where("rep is not null and vector is not null").select(F.col("d1").alias("text"), F.col("rep").alias("doc_id"), "n", "vector")
    members = runs.where("run is not null").select("run", "text").repartition("text").distinct().join(named.hint("merge"), "text")
    members = members.select("run", "doc_id", "n", "vector").repartition("run").sortWithinPartitions("run", "doc_id")
    reps = texts.where("rep is not null").select("d1", "rep")
    stars = runs.where("head is not null").select("text", "head").distinct()
    stars = stars.join(reps.toDF("text", "src"), "text").join(reps.toDF("head", "dst"), "head").select("src", "dst")
    edges = in_batches(members, _pairs(threshold), "src long, dst long").union(stars)
    clusters = saved(components(edges).selectExpr("node as doc_id", "component as cluster"))
    released(runs)
    sets = in_batches(docs.join(small(clusters, 16), "doc_id").select("doc_id", "cluster", "text"), _sized(shingle), "doc_id long, cluster long, n long, text string")
    sets = saved(sets.where("n > 0").dropDuplicates(["doc_id", "cluster", "text"]))
    # Rows of one id with several texts share a component through it.
    mixed = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    same_id = rows.join(mixed, "doc_id").join(texts.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    found = components(linked(sets, threshold, shingle).union(same_id))
    labelled = texts.join(found, texts["rep"] == found["node"], "left").where("copies > 1 or component is not null")
    labelled = saved(labelled.select("d1", "d2", "n", "copies", F.coalesce("component", "rep").alias("c")))
    total = rows.count()
    key = ["d1", "d2", "n"]
    hot = F.broadcast(labelled.where(F.col("copies") * HOT >= total).drop("copies"))  # at most HOT rows: their copies add up to no more than all
    cold = labelled.where(F.col("copies") * HOT < total).drop("copies")
    plain = rows.where("n = 0").select(*rows.columns, F.lit(None).cast("long").alias("c"))
    full = rows.where("n > 0")
    out = plain.unionByName(full.join(hot, key)).unionByName(full.join(hot, key, "left_anti").join(cold, key, "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
