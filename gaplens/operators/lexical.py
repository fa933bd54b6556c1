"""Lexical spaces: TF-IDF rows over up to 40,000 terms and a randomized truncated SVD, both from partitioned rows.

A space is two tables: its terms (block, term, place, idf) and its projection in slices of
places, so that it is fitted, kept and applied in the same form. The fit multiplies a
V x l matrix by the corpus' Gram matrix a few times; V and l are parameters, so what the
driver holds between two passes does not follow the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.operators import terms
from gaplens.operators.blocks import partials, summed
from gaplens.sources.shared import settled

# Components, seed, and the terms kept by kind of space.
COMPONENTS = 256
SEED = 42
FEATURES = {"char_wb": (("char", 40_000),), "word": (("word", 20_000),), "union": (("word", 12_000), ("char", 30_000))}
#: Directions tried beyond the components, and passes over the corpus; fewer where the directions span it before.
EXTRA = 32
PASSES = 3
#: Singular values below this share of the greatest are none.
LEAST = 1e-7
#: Places of a slice of a matrix, rows merged together, rows multiplied together and the share of them (one in so many) that makes a place a dense column,
#: cells that are worth a task of their own, rows that are projected together.
SLICE = 1024
ROWS = 256
GATHERED = 2048
THIN = 30
TASK_CELLS = 1 << 21
CHUNK = 2048
#: Documents whose counts are held together, and characters looked up together.
TOLD = 32
PIECE = 1 << 18


def _clean(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text); dealt anew where a corpus lies in few partitions, as each text becomes some hundred terms."""
    spread = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < spread:
        docs = docs.select(key, text).repartition(spread)
    return docs.select(F.col(key).alias("id"), F.coalesce(F.nullif(F.trim(F.col(text)), F.lit("")), F.lit(" ")).alias("text"))


def _found(kind: str) -> Column:
    return terms.char_terms(F.col("text")) if kind == "char" else terms.word_terms(F.col("text"))


def _said(docs: DataFrame, blocks: list[str]) -> DataFrame:
    """(block, unit, total): how often all documents together say what their terms are read from."""
    parts = [docs.select(F.lit(b).alias("block"), F.explode(terms.padded_words(F.col("text")) if b == "char" else terms.word_terms(F.col("text"))).alias("unit")) for b in blocks]
    return reduce(DataFrame.unionByName, parts).groupBy("block", "unit").agg(F.count("*").alias("total"))


def _units(docs: DataFrame, blocks: list[str]) -> DataFrame:
    """(id, block, unit, n): what a document's terms are read from, each once with its count: padded words for characters, the terms themselves for words."""
    out = None
    for block in blocks:
        found = terms.padded_words(F.col("text")) if block == "char" else terms.word_terms(F.col("text"))
        part = docs.select("id", F.lit(block).alias("block"), F.explode(found).alias("unit")).groupBy("id", "block", "unit").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return settled(out)


def _terms_of(units: DataFrame, *kept: str) -> DataFrame:
    """(block, term, kept columns): a row for every term in a unit."""
    found = F.when(F.col("block") == "char", terms.word_grams(F.col("unit"))).otherwise(F.array("unit"))
    return units.select("block", F.explode(found).alias("term"), *kept)


def _counted(docs: DataFrame, vocabulary: DataFrame, blocks: list[str]) -> DataFrame:
    """(id, places array<int>, tf array<double>): 1 + the logarithm of each known term's count; a document without any is no row.

    Characters alone are looked up where the text lies. With words beside them each different unit is taken apart once and meets the documents as a list of places, so terms are counted by number, where their document lies.
    """
    if blocks == ["char"]:
        known = vocabulary.select("term", "place").orderBy("place").toArrow()  # at most FEATURES rows
        joined = F.array_join(terms.padded_words(F.col("text")), "")  # a space at each end of each word
        return docs.select("id", joined.alias("text")).mapInArrow(_looked_up(Prefixes.of(known["term"].to_pylist(), known["place"].to_numpy())), f"id {dict(docs.dtypes)['id']}, places array<int>, tf array<double>")
    units = _units(docs, blocks)
    known = _terms_of(units.select("block", "unit").distinct(), "unit").join(F.broadcast(vocabulary.select("block", "term", "place")), ["block", "term"])  # at most FEATURES rows
    lists = known.groupBy("block", "unit", "place").agg(F.count("*").alias("m")).groupBy("block", "unit").agg(F.collect_list(F.struct("place", "m")).alias("p"))  # a word's terms
    lists = lists.select("block", "unit", F.col("p.place").alias("places"), F.col("p.m").cast("array<int>").alias("m"))
    met = units.join(lists, ["block", "unit"]).groupBy("id").agg(F.collect_list(F.struct("n", "places", "m")).alias("row"))  # a document's words
    return met.mapInArrow(_merged, f"id {dict(units.dtypes)['id']}, places array<int>, tf array<double>")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass
class Prefixes:
    """Terms of 3 to 5 characters by their prefixes: for each length the sorted keys, made of the shorter prefix's number and the next character, and each prefix's place (-1: no term)."""

    keys: list[np.ndarray]
    places: list[np.ndarray]
    width: int

    @classmethod
    def of(cls, found: list[str], places: np.ndarray) -> Prefixes:
        points = [_points(t) for t in found]
        at, keys, held = [0] * len(points), [], []
        for n in (3, 4, 5):
            mine = [i for i, p in enumerate(points) if len(p) >= n]
            key = np.array([int(points[i][0]) << 42 | int(points[i][1]) << 21 | int(points[i][2]) if n == 3 else at[i] << 21 | int(points[i][n - 1]) for i in mine], np.int64)
            known, number = np.unique(key, return_inverse=True)
            place = np.full(len(known), -1, np.int64)
            for i, j in zip(mine, number, strict=True):
                at[i] = int(j)
                if len(points[i]) == n:
                    place[j] = places[i]
            keys.append(known)
            held.append(place)
        return cls(keys, held, int(max(places, default=-1)) + 1)

    def found(self, points: np.ndarray, starts: int):
        """(where, place) of the known terms that begin in the first `starts` characters; none has a space within."""
        inside = points != 32
        at = np.flatnonzero(inside[1:-1][:starts])  # the second character is no space, and there is a third
        number = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
        for n, keys, places in zip((3, 4, 5), self.keys, self.places, strict=True):
            if not len(keys):
                return
            j = np.minimum(np.searchsorted(keys, number), len(keys) - 1)
            hit = keys[j] == number
            at, j = at[hit], j[hit]
            place = places[j]
            yield at[place >= 0], place[place >= 0]
            on = (at + n < len(points)) & inside[at + n - 1]
            at, j = at[on], j[on]
            number = j << 21 | points[at + n]


def _looked_up(known: Prefixes):
    """Counts of known terms of documents (id, padded words), TOLD documents and PIECE characters at a time."""

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), TOLD):
                batch = whole.slice(first, TOLD)
                texts = [_points(t) for t in batch.column(1).to_pylist()]
                counts = np.zeros(len(batch) * known.width, np.int64)
                for d, text in enumerate(batch.column(1)):
                    mine, doc = counts[d * known.width : (d + 1) * known.width], _points(text.as_py())
                    for begin in range(0, len(doc), PIECE):
                        for _, place in known.found(doc[begin : begin + PIECE + 4], PIECE):
                            mine += np.bincount(place, minlength=known.width)
                cell = np.flatnonzero(counts)
                yield _rows(batch.column(0), cell // max(1, known.width), cell % max(1, known.width), counts[cell])

    return run


def _rows(ids: pa.Array, doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counted documents from cells in their order; one without a cell is no row."""
    ends = np.searchsorted(doc, np.arange(len(ids) + 1))
    some = pa.array(np.diff(ends) > 0)
    of = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)).filter(some)
    return pa.RecordBatch.from_arrays([ids.filter(some), of(place.astype(np.int32)), of(1 + np.log(n))], names=["id", "places", "tf"])


def _merged(batches):
    """The counts of a document's terms from its words' lists, ROWS documents at a time."""
    lengths = lambda x: x.value_lengths().to_numpy(zero_copy_only=False)
    values = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    for whole in batches:
        for first in range(0, len(whole), ROWS):
            batch = whole.slice(first, ROWS)
            words = batch.column(1).flatten()
            n, places, m = (words.field(i) for i in range(3))
            inside = lengths(places)
            doc = np.repeat(np.repeat(np.arange(len(batch)), lengths(batch.column(1))), inside)
            at, cell = np.unique(doc << 32 | values(places), return_inverse=True)
            tf = 1 + np.log(np.bincount(cell, np.repeat(n.to_numpy(), inside) * values(m), len(at)))
            ends = pa.array(np.searchsorted(at, np.arange(len(batch) + 1) << 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array((at & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf))], names=["id", "places", "tf"])


def _weighed(counts: DataFrame, vocabulary: DataFrame, packed: bool = False) -> DataFrame:
    """(id, places, weights) of counted documents: tf times idf; each block of terms over its own norm, then the row over its own. Packed, both lists are their numbers' bytes."""
    known = vocabulary.select("place", "idf", (F.col("block") == "word").alias("word")).orderBy("place").toArrow()  # at most FEATURES rows
    idf, word = known["idf"].to_numpy(), known["word"].to_numpy().astype(np.int64)

    def run(batches):
        for batch in batches:
            places, tf = batch.column(1), batch.column(2)
            at = places.flatten().to_numpy(zero_copy_only=False)
            part = 2 * np.repeat(np.arange(len(batch)), places.value_lengths().to_numpy(zero_copy_only=False)) + word[at]  # a document's block
            w = tf.flatten().to_numpy(zero_copy_only=False) * idf[at]
            squares = np.bincount(part, w * w, 2 * len(batch))
            blocks = (np.bincount(part, minlength=2 * len(batch)) > 0).reshape(-1, 2).sum(1)  # every block has norm 1, so the row's is the root of their number
            w = w / np.sqrt(squares)[part] / np.sqrt(blocks)[part // 2]
            ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))])
            made = [_bytes(x, ends) for x in (at.astype(np.int32), w)] if packed else [places, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "places", "weights"])

    kinds = "places binary, weights binary" if packed else "places array<int>, weights array<double>"
    return counts.mapInArrow(run, f"id {dict(counts.dtypes)['id']}, {kinds}")


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers between each two ends as a row of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists or of bytes, and how many each row has."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // size
    return np.frombuffer(column.buffers()[2] or b"", kind)[ends[0] : ends[-1]] if len(column) else np.zeros(0, kind), np.diff(ends)


def _unpacked(batches):
    for batch in batches:
        parts = [batch.column(0)]
        for column, kind in ((batch.column(1), np.int32), (batch.column(2), np.float64)):
            values, sizes = _numbers(column, kind)
            parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values)))
        yield pa.RecordBatch.from_arrays(parts, names=["id", "places", "weights"])


@dataclass
class Space:
    """A fitted space. `terms`: (block, term, place, idf); `slices`: (slice, data) of the projection, SLICE places each, row by row; `rows`: the weights of the corpus where it was fitted here."""

    terms: DataFrame
    slices: DataFrame
    features: int
    components: int
    rows: DataFrame | None = None

    @classmethod
    def fit(cls, docs: DataFrame, key: str, text: str, grams: str = "char_wb", features: int | None = None, components: int = COMPONENTS) -> Space:
        """From a corpus; `features` replaces the terms kept of a space of one kind."""
        clean = settled(_clean(docs, key, text))
        n = clean.count()
        blocks = [block for block, _ in FEATURES[grams]]
        totals = settled(_terms_of(_said(clean, blocks), "total").groupBy("block", "term").agg(F.sum("total").alias("total")))
        parts = []
        for block, most in FEATURES[grams]:
            most = features if features is not None and len(FEATURES[grams]) == 1 else most
            parts.append(totals.where(F.col("block") == block).orderBy(F.desc("total"), "term").limit(most).select("block", "term"))
        kept = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        place = F.row_number().over(Window.orderBy("block", "term")) - 1  # at most FEATURES rows
        placed = settled(kept.select("block", "term", place.alias("place")))
        counts = settled(_counted(clean, placed, blocks))
        documents = counts.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("docs"))
        vocabulary = settled(placed.join(documents, "place").select("block", "term", "place", (F.log(F.lit(1.0 + n) / (1 + F.col("docs"))) + 1).alias("idf")))
        width = vocabulary.count()
        packed = settled(_weighed(counts, vocabulary, packed=True))  # every pass reads it: bytes come through as they lie
        rows = packed.mapInArrow(_unpacked, f"id {dict(packed.dtypes)['id']}, places array<int>, weights array<double>")
        cells = counts.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
        # A task's partial sum is a whole matrix: no more of them than the work asks for, nor than run at a time.
        tasks = max(1, min(-(-cells // TASK_CELLS), docs.sparkSession.sparkContext.defaultParallelism))
        wanted = min(components, max(2, width - 1), max(2, n - 1))
        projection = _projection(packed.coalesce(tasks), width, wanted)
        data = [(s, bytearray(projection[s * SLICE : (s + 1) * SLICE].tobytes())) for s in range(-(-width // SLICE))]
        slices = settled(docs.sparkSession.createDataFrame(data, "slice int, data binary"))
        return cls(vocabulary, slices, width, projection.shape[1], rows)

    def weights(self, docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        return weights(_clean(docs, key, text), self.terms)

    def transform(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding): unit vectors of any documents; one without a known term is a zero vector, also if its text is null."""
        clean = _clean(docs, key, text)
        return self.project(clean.select("id").join(weights(clean, self.terms), "id", "left")).withColumnRenamed("id", key)

    def project(self, rows: DataFrame) -> DataFrame:
        """(id, embedding) of rows (id, places, weights); null weights are none. The projection goes to the tasks, its size bounded by the parameters."""
        parts = [np.frombuffer(r["data"]).reshape(-1, self.components) for r in self.slices.orderBy("slice").collect()] if self.components else []
        projection = np.concatenate(parts) if parts else np.zeros((0, self.components))
        shared = rows.sparkSession.sparkContext.broadcast(projection)
        return rows.select("id", "places", "weights").mapInArrow(_projected(shared), f"id {dict(rows.dtypes)['id']}, embedding array<double>")


def weights(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, places array<int>, weights array<double>) of documents (id, text): sublinear TF-IDF of the vocabulary's terms."""
    blocks = [r["block"] for r in vocabulary.select("block").distinct().orderBy("block").collect()] or ["char"]  # two at most
    return _weighed(_counted(docs, vocabulary, blocks), vocabulary)


def _gathered(batch: pa.RecordBatch):
    """(row, place, weight) of the cells of sparse rows (places, weights), GATHERED rows at a time, with the number of rows."""
    for first in range(0, len(batch), GATHERED):
        (places, sizes), (weights, _) = (_numbers(batch.column(c).slice(first, GATHERED), kind) for c, kind in ((0, np.int32), (1, np.float64)))
        yield len(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), places, weights


def _add_gram(total: np.ndarray, q: np.ndarray, n: int, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
    """Adds the Gram matrix of n rows times q to total.

    Places that more than one row in THIN has are dense columns, SLICE of them multiplied together; the cells of the others, most of
    the places and few of the cells, are taken one by one: by row on the way to the rows, by place on the way back.
    """
    count = np.bincount(place, minlength=len(q))
    many = np.flatnonzero(count * THIN > n)
    column = np.full(len(q), -1, np.int32)
    column[many] = np.arange(len(many))
    at = column[place]
    thick = at >= 0
    at, place_r, row_r, weight_r = at[thick], place[~thick], row[~thick], weight[~thick]
    order = np.argsort((at // SLICE).astype(np.int16), kind="stable")
    at, row_d, weight_d = at[order], row[thick][order], weight[thick][order]
    slices = range(0, len(many), SLICE)
    ends = [*np.searchsorted(at // SLICE, np.arange(len(slices))), len(at)]

    def dense(i: int) -> np.ndarray:
        mine, first = slice(ends[i], ends[i + 1]), i * SLICE
        out = np.zeros((n, min(SLICE, len(many) - first)))
        out[row_d[mine], at[mine] - first] = weight_d[mine]
        return out

    met = np.zeros((n, q.shape[1]))
    for i, first in enumerate(slices):
        met += dense(i) @ q[many[first : first + SLICE]]
    ends_r = np.concatenate([[0], np.cumsum(np.bincount(row_r, minlength=n))])
    for r in np.flatnonzero(np.diff(ends_r)).tolist():
        mine = slice(ends_r[r], ends_r[r + 1])
        met[r] += weight_r[mine] @ q[place_r[mine]]
    for i, first in enumerate(slices):
        total[many[first : first + SLICE]] += dense(i).T @ met
    order = np.argsort(place_r, kind="stable")
    row_r, weight_r = row_r[order], weight_r[order]
    few = np.flatnonzero((count > 0) & (column < 0))
    ends_p = np.concatenate([[0], np.cumsum(count[few])])
    for i, p in enumerate(few.tolist()):
        mine = slice(ends_p[i], ends_p[i + 1])
        total[p] += weight_r[mine] @ met[row_r[mine]]


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """Gram matrix of the sparse rows times q, summed over partitions in slices of places."""
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        total = np.zeros(q.shape)
        for batch in batches:
            for part in _gathered(batch):
                _add_gram(total, q, *part)
        touched = np.flatnonzero([total[s : s + SLICE].any() for s in range(0, len(q), SLICE)])
        yield from partials({int(s): total[s * SLICE : (s + 1) * SLICE] for s in touched})

    out = np.zeros(q.shape)
    for s, data in summed(rows.select("places", "weights"), run).items():
        out[s * SLICE : (s + 1) * SLICE] = data.reshape(-1, q.shape[1])
    shared.unpersist()
    return out


def _projection(rows: DataFrame, width: int, wanted: int) -> np.ndarray:
    """The leading right singular vectors: random directions, power passes with a QR each, and a small eigenproblem at the end.

    Passes end early where the directions hold the whole corpus or no longer turn.
    """
    tried = min(width, wanted + EXTRA)
    if not tried:
        return np.zeros((width, 0))
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.normal(size=(width, tried)))[0]
    before = None
    for _ in range(PASSES):
        z = _gram_times(rows, q)
        values = np.linalg.eigvalsh(q.T @ z)[::-1][:wanted]
        q = np.linalg.qr(z)[0]
        if before is not None and np.allclose(values, before, rtol=1e-10, atol=1e-12 * max(1e-300, abs(values[0]))):
            break
        before = values
    z = _gram_times(rows, q)
    values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > LEAST * LEAST * max(1e-300, float(values.max()))]
    found = q @ turn[:, order]
    return found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0) if found.size else found


def _projected(shared):
    def run(batches):
        projection = shared.value
        for whole in batches:
            for first in range(0, len(whole), CHUNK):
                batch = whole.slice(first, CHUNK)
                sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                at, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                out = np.zeros((len(batch), projection.shape[1]))
                for i in np.flatnonzero(sizes):
                    cells = slice(bounds[i], bounds[i + 1])
                    v = w[cells] @ projection[at[cells]]
                    norm = np.linalg.norm(v)
                    out[i] = v / norm if norm > 0 else v
                width = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(width, pa.array(out.ravel(), pa.float64()))], names=["id", "embedding"])

    return run
