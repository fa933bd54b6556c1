"""Reversible line dedup over exact reference counts and sharded cuckoo filters (operator 7).

A line's key is its text without white space at both ends, A-Z lower-cased. Exact tables
hold, for every key of enough code points, which documents have it (postings) and how
many they are (reference counts). Each shard of keys whose count reaches the limit has a
cuckoo filter: it takes single insertions and deletions, so documents can be added and
withdrawn without a rebuild. Postings are dealt out by shard, where the shard's filter
spares all lines it does not know the join with the exact table, which settles the rest.
Shards follow the number of postings and keys. Keys with a thousandth of all postings or
more, of which there are at most a thousand, are settled apart, so no task gets one whole.

Defined results: a null or empty text is one empty line; repeated ids are one document
(each row loses its lines alike); rows with a null id are not counted and lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches, released, saved

MIN_CHARS = 20
MIN_DOCS = 3
#: A shard of the filters has about so many postings, and so many keys at most on average.
SHARD_POSTINGS = 1 << 15
SHARD_KEYS = 1 << 12
#: A key with at least this share of all postings is hot: there are at most HOT of them.
HOT = 1000
SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; two candidate buckets a key; no false negatives."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = len(table) - 1
        self._state = 0x2545F491

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = len(keys)
        while True:
            out = cls(capacity)
            if out.insert(keys):
                return out
            capacity = 2 * max(capacity, 8)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.int64)
        prints = np.where(prints == 0, 1, prints)
        first = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64) & self.mask
        return prints, first, (first ^ self._hop(prints)) & self.mask

    @staticmethod
    def _hop(prints):
        return prints * 0x5BD1E995

    def insert(self, keys: np.ndarray) -> bool:
        """Take all keys, or say that one found no place: the filter is then to be made anew, larger."""
        prints, a, b = self._places(keys)
        left = np.flatnonzero(~self._filled(prints, a))
        left = left[~self._filled(prints[left], b[left])]
        return all(self._kicked(p, at) for p, at in zip(prints[left].tolist(), a[left].tolist(), strict=True))

    def _filled(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put prints into free slots of their buckets, all at once; which found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        slot = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        ok = slot.any(1)
        self.table[bucket[ok], slot[ok].argmax(1)] = prints[order][ok]
        out = np.zeros(len(at), bool)
        out[order] = ok
        return out

    def _kicked(self, prints: int, at: int) -> bool:
        """Move others to their second bucket until one slot is free."""
        for _ in range(MAX_KICKS):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = prints
                return True
            self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self._state >> 8) % SLOTS
            prints, self.table[at, slot] = int(self.table[at, slot]), prints
            at = (at ^ self._hop(prints)) & self.mask
        return False

    def delete(self, key: int) -> bool:
        """Remove one copy of a key that was inserted."""
        prints, a, b = (int(x[0]) for x in self._places(np.array([key], np.uint64)))
        for at in (a, b):
            found = np.flatnonzero(self.table[at] == prints)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        prints = prints[:, None]
        return (self.table[a] == prints).any(1) | (self.table[b] == prints).any(1)

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def line_keys(body: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Starts, ends and rows of all lines; which are long enough; two hashes of those."""
    starts, ends, rows = tv.line_spans(body, offsets)
    low = tv.LOWER[body]
    a, b = tv.stripped(body, starts, ends)
    points = tv.code_points(body)
    long = points[b] - points[a] >= min_chars
    h1 = tv.hashes(low, a[long], b[long])
    return starts, ends, rows, long, h1, tv.mix(h1 ^ tv.hashes(low[::-1], len(body) - b[long][::-1], len(body) - a[long][::-1])[::-1], 31)


def _postings(min_chars: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, body, offsets in tv.chunks(batch.column(1)):
                _, _, rows, long, h1, h2 = line_keys(body, offsets, min_chars)
                if not long.any():
                    continue
                r = rows[long]
                order = np.lexsort((h2, h1, r))
                r, h1, h2 = r[order], h1[order], h2[order]
                once = np.ones(len(r), bool)
                once[1:] = (r[1:] != r[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                yield pa.record_batch([ids.take(pa.array(r[once] + first)), pa.array(h1[once].view(np.int64)), pa.array(h2[once].view(np.int64))], names=["row_id", "k1", "k2"])

    return run


def n_shards(n_postings: int, n_keys: int) -> int:
    most = max(n_postings // SHARD_POSTINGS, n_keys // SHARD_KEYS, 1)
    return 1 << (most - 1).bit_length()


def _known(batches):
    """The postings that their shard's filter knows; rows come by shard, its filter first. One filter is held at a time."""
    now, table = None, None
    for batch in batches:
        shards, filters = batch.column(0).to_numpy(), batch.column(1)
        keys = batch.column(3).fill_null(0).to_numpy().view(np.uint64)
        hit = np.zeros(len(shards), bool)
        cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
        for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
            if shards[a] != now:
                now, table = shards[a], None
            while a < b and filters[int(a)].is_valid:
                table = CuckooFilter.frombytes(filters[int(a)].as_py())
                a += 1
            if table is not None and a < b:
                hit[a:b] = table.contains(keys[a:b])
        if hit.any():
            yield pa.record_batch(batch.columns[2:], names=["row_id", "k1", "k2"]).filter(pa.array(hit))


class LineIndex:
    """Postings (row_id, k1, k2), reference counts (k1, k2, n_docs, keeper) and filters by shard.

    insert() and delete() give a new index; deleting what was inserted restores every count.
    """

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.postings, self.counts, self.filters, self.shards = postings, counts, filters, shards
        self.min_docs, self.min_chars = min_docs, min_chars

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        return cls._made(saved(cls._lines(docs, id_col, text_col, min_chars)), min_docs, min_chars)

    @classmethod
    def _made(cls, postings: DataFrame, min_docs: int, min_chars: int, counts: DataFrame | None = None) -> LineIndex:
        counts = saved(cls._counted(postings, min_docs)) if counts is None else counts
        shards = n_shards(postings.count(), counts.count())

        def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _filter_row(key, CuckooFilter.of(table["k1"].to_numpy().view(np.uint64)).tobytes())

        filters = saved(counts.select(shard_of(F.col("k1"), shards).alias("shard"), "k1").groupBy("shard").applyInArrow(make, "shard long, filter binary"))
        return cls(postings, counts, filters, shards, min_docs, min_chars)

    @staticmethod
    def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
        rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).where("row_id is not null")
        return in_batches(rows, _postings(min_chars), f"row_id {dict(rows.dtypes)['row_id']}, k1 long, k2 long")

    @staticmethod
    def _counted(postings: DataFrame, min_docs: int) -> DataFrame:
        counted = postings.groupBy("k1", "k2").agg(F.countDistinct("row_id").alias("n_docs"), F.max("row_id").alias("keeper"))
        return counted.where(F.col("n_docs") >= min_docs)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        added = self._lines(docs, id_col, text_col, self.min_chars)
        return self._moved(saved(self.postings.union(added).distinct()))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        gone = ids.select(F.col(id_col).alias("row_id")).distinct()
        return self._moved(saved(self.postings.join(gone, "row_id", "left_anti")))

    def _moved(self, postings: DataFrame) -> LineIndex:
        """Counts of the new postings; filters take or lose the keys that crossed the limit. A filter that is full, or shards
        that have become too few, are made anew from the counts."""
        counts = saved(self._counted(postings, self.min_docs))
        keys = lambda df, sign: df.select("k1", "k2", F.lit(sign).alias("sign"))
        old, new = keys(self.counts, -1), keys(counts, 1)
        changed = new.join(old, ["k1", "k2"], "left_anti").unionByName(old.join(new, ["k1", "k2"], "left_anti"))
        changed = changed.select(shard_of(F.col("k1"), self.shards).alias("shard"), "k1", "sign")

        def turn(key: tuple[pa.Scalar, ...], before: pa.Table, delta: pa.Table) -> pa.Table:
            table = CuckooFilter.frombytes(before["filter"][0].as_py()) if len(before) else CuckooFilter(0)
            moved, sign = delta["k1"].to_numpy().view(np.uint64), delta["sign"].to_numpy()
            for k in moved[sign < 0].tolist():
                table.delete(k)
            return _filter_row(key, table.tobytes() if table.insert(moved[sign > 0]) else b"")

        filters = saved(self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInArrow(turn, "shard long, filter binary"))
        full = filters.where(F.length("filter") == 0).limit(1).count()
        if full or n_shards(postings.count(), counts.count()) > 2 * self.shards:
            return self._made(postings, self.min_docs, self.min_chars, counts)
        return LineIndex(postings, counts, filters, self.shards, self.min_docs, self.min_chars)

    def release(self) -> None:
        for table in (self.postings, self.counts, self.filters):
            released(table)

    def suspects(self, postings: DataFrame | None = None) -> DataFrame:
        """The postings whose key a filter knows. They go to their shard's filter, not the filters to them."""
        postings = self.postings if postings is None else postings
        id_type = dict(postings.dtypes)["row_id"]
        rows = postings.select(shard_of(F.col("k1"), self.shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "row_id", "k1", "k2")
        filters = self.filters.select("shard", "filter", F.lit(None).cast(id_type).alias("row_id"), F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
        dealt = rows.union(filters).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return in_batches(dealt, _known, f"row_id {id_type}, k1 long, k2 long")

    def drops(self) -> DataFrame:
        """(row_id, keys): the keys whose lines each document loses."""
        total = self.postings.count()
        hot = self.counts.where(F.col("n_docs") * HOT >= total).select("k1", "k2", F.col("keeper").alias("hot_keeper"))
        split = self.postings.join(F.broadcast(hot), ["k1", "k2"], "left")  # at most HOT rows: their postings add up to no more than all
        cold = split.where("hot_keeper is null").select("row_id", "k1", "k2")
        lost = self.suspects(cold).join(self.counts.hint("merge"), ["k1", "k2"]).where(F.col("row_id") != F.col("keeper")).select("row_id", "k1", "k2")
        lost = lost.union(split.where("row_id <> hot_keeper").select("row_id", "k1", "k2"))
        return lost.groupBy("row_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))  # at most a document's lines


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(key, 32), F.lit(shards)).cast("long")


def _filter_row(key: tuple[pa.Scalar, ...], data: bytes) -> pa.Table:
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([data], pa.binary())})


def _dropped(at_text: int, at_keys: int, min_chars: int):
    def run(batches):
        for batch in batches:
            texts, lost = batch.column(at_text).cast(pa.string()), batch.column(at_keys)
            flat = lost.flatten()
            k1, k2 = (flat.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            sizes = lost.value_lengths().fill_null(0).to_numpy()
            upto = np.concatenate([[0], np.cumsum(sizes)])
            out, n_lines, n_dropped = [], [], []
            for first, body, offsets in tv.chunks(texts):
                starts, ends, rows, long, h1, h2 = line_keys(body, offsets, min_chars)
                bounds = tv.row_bounds(rows, len(offsets) - 1)
                gone = np.zeros(len(rows), bool)
                marks = slice(upto[first], upto[first + len(offsets) - 1])
                if marks.stop > marks.start:
                    owner = np.repeat(np.arange(len(offsets) - 1), sizes[first : first + len(offsets) - 1])
                    gone[long] = np.isin(_in_row(rows[long], h1, h2), _in_row(owner, k1[marks], k2[marks]))
                raw = body.tobytes()
                lost_in = np.add.reduceat(gone.astype(np.int64), bounds[:-1])
                for i in range(len(offsets) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    n_lines.append(int(b - a))
                    n_dropped.append(int(lost_in[i]))
                    if lost_in[i]:
                        out.append(b"\n".join(raw[starts[j] : ends[j]] for j in range(a, b) if not gone[j]))
                    else:
                        out.append(raw[offsets[i] : offsets[i + 1]])
            columns = [x for i, x in enumerate(batch.columns) if i != at_keys]
            columns[at_text] = pa.array(out, pa.binary()).cast(pa.string())
            names = [x for i, x in enumerate(batch.schema.names) if i != at_keys]
            yield pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "__n_lines", "__n_dropped"])

    return run


def _in_row(owner: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return tv.mix(h1 ^ tv.mix(owner.astype(np.uint64))) ^ h2


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the index's repeated lines cut from the text, and __n_lines and __n_dropped."""
    return _without(docs, saved(index.drops()), index.min_chars, id_col, text_col)


def _without(docs: DataFrame, drops: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    # The lists follow the documents in number and length, so they are never broadcast: each text is shuffled once, at any size.
    drops = drops.select(F.col("row_id").alias("__row_id"), F.col("keys").alias("__keys")).hint("merge")
    joined = docs.join(drops, F.col(id_col) == F.col("__row_id"), "left").drop("__row_id")
    at = docs.columns.index(text_col)
    fields = [T.StructField(x.name, T.StringType()) if x.name == text_col else x for x in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    return in_batches(joined, _dropped(at, len(docs.columns), min_chars), schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    index = LineIndex.build(docs, id_col, text_col, min_docs, min_chars)
    drops = saved(index.drops())
    index.release()
    return _without(docs, drops, min_chars, id_col, text_col)
