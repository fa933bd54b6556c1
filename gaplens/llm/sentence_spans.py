"""Substring dedup on sliding sentence spans (operator 2).

A sentence ends at `.`, `!` or `?` before white space, at a line feed, or at the end of
the text; the white space after it belongs to it. Spans are equal if their words are
(`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), by 128-bit hash. Of the equal spans of all
texts the first, by id and then position, stays; later ones are copies.

`dedup_runs` hashes every run of MIN_SENTENCES sentences, however short. Copies that
overlap merge into stretches, and the sentences of a stretch of MIN_WORDS words go, so
every whole sentence of a repeated passage of that length goes. The runs of one stretch
may have their firsts in different texts. `dedup_spans` has one span from each sentence,
over the fewest sentences, MIN_SENTENCES at least, that hold MIN_WORDS words; every
sentence that a copy covers goes.

Spans travel once, as (hash, id, position, size) without text. Equal spans within a batch
of a task leave only their first one to travel by hash, since the others are copies whatever
the rest holds; so a very common span sends one row a batch. Sorted by hash and place, the
spans are read in one pass that remembers the current first and gives the later ones. The
copies of a document meet its text in a join that shuffles each text once, at any size:
the copies grow with the documents, so they are never broadcast.

Defined results: null and empty texts have no sentences and stay as they are; rows of
one id are one document, whose equal positions are never each other's copies; a null id
is never changed and is no first; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches

MIN_SENTENCES = 2
MIN_WORDS = 24
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def sentence_starts(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of each sentence; leading white space joins the first one."""
    words, ends, rows = tv.word_spans(body, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds = np.concatenate([[0], np.cumsum(body == 10)])
    opens = np.ones(len(words), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | _STOP[body[ends[:-1] - 1]] | (feeds[words[1:]] > feeds[ends[:-1]])
    starts, owner = words[opens], rows[opens]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.where(first, offsets[owner], starts)
    return starts, owner


def span_hashes(body: np.ndarray, offsets: np.ndarray, min_sentences: int, min_words: int):
    """(row, position, sentences, hash, hash) of every span; its position is its first sentence in the row."""
    starts, owner = sentence_starts(body, offsets)
    words, ends, rows = tv.word_spans(body, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    low = tv.LOWER[body]
    at = np.searchsorted(words, starts)  # first word of each sentence
    upto = np.append(at, len(words))
    row_last = np.searchsorted(owner, owner, "right")  # past the last sentence of the row
    end = np.maximum(np.searchsorted(upto, at + min_words), np.arange(n) + min_sentences)
    ok = np.flatnonzero(end <= row_last)
    a, b = upto[ok], upto[end[ok]]
    out = []
    for salt in (31, 32):
        h = tv.hashes(low, words, ends, salt)
        # Polynomial hash of a word range from prefix sums: powers rise along a row's words.
        inverse = pow(tv._BASE, -1, 2**64)
        base = np.searchsorted(rows, rows)
        j = np.arange(len(words)) - base
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * tv.powers(int(j.max()) + 1)[j])])
        down = np.full(int(j.max()) + 1, inverse, np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        out.append(tv.mix((prefix[b] - prefix[a]) * down[j[a]] + (b - a).astype(np.uint64), salt))
    position = np.arange(n) - np.searchsorted(owner, owner)
    return owner[ok], position[ok], end[ok] - ok, out[0], out[1]


def _spans(min_sentences: int, min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, body, offsets in tv.chunks(batch.column(1)):
                row, position, size, h1, h2 = span_hashes(body, offsets, min_sentences, min_words)
                if not len(row):
                    continue
                # Ranks of the ids order places as the ids do; equal ids share a rank.
                rank = pc.rank(ids.slice(first, len(offsets) - 1), tiebreaker="min").to_numpy().astype(np.int64)[row]
                order = np.lexsort((position, rank, h2, h1))
                a, b, r, p = h1[order], h2[order], rank[order], position[order]
                same = np.zeros(len(a), bool)
                same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
                again = (r == r[head]) & (p == p[head]) & same  # a repeated row of one document
                later = same & ~again
                # A copy that is known needs no company: its key deals it out evenly.
                a = np.where(later, tv.mix(a ^ tv.mix(r.astype(np.uint64), 51) ^ p.astype(np.uint64), 52), a)
                kept = np.flatnonzero(~again)
                place = (p[kept] << 32) | size[order][kept]
                columns = [pa.array(a[kept].view(np.int64)), pa.array(b[kept].view(np.int64)), ids.take(pa.array(row[order][kept] + first)), pa.array(place), pa.array(later[kept])]
                yield pa.record_batch(columns, names=["h1", "h2", "row_id", "place", "later"])

    return run


def _copies(batches):
    """(row_id, place) of the spans that are no firsts; rows come by hash, id and place."""
    last = None  # hash and place of the current first
    for batch in batches:
        if not len(batch):
            continue
        h1, h2, place = (batch.column(i).to_numpy() for i in (0, 1, 3))
        ids, later = batch.column(2), batch.column(4).to_numpy(zero_copy_only=False)
        every = np.arange(len(h1))
        opens = np.ones(len(h1), bool)
        opens[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        known = last is not None and last[:2] == (h1[0], h2[0])
        opens[0] = not known
        head = np.maximum.accumulate(np.where(opens, every, -1))
        codes = pc.dictionary_encode(ids).indices.to_numpy()
        own = (codes == codes[head]) & (place >> 32 == place[head] >> 32)
        for i in np.flatnonzero(head < 0):  # the run that the batch before began
            own[i] = ids[int(i)].as_py() == last[2] and place[i] >> 32 == last[3]
        if head[-1] >= 0:
            last = (h1[-1], h2[-1], ids[int(head[-1])].as_py(), place[head[-1]] >> 32)
        out = later | ~own
        if out.any():
            at = pa.array(np.flatnonzero(out))
            yield pa.record_batch([ids.take(at), batch.column(3).take(at)], names=["row_id", "place"])


def _covered(spans: list[int], n: int, words: np.ndarray, stretch_words: int) -> np.ndarray:
    """Which of n sentences the spans cover, in stretches of overlapping spans with stretch_words words or more."""
    gone = np.zeros(n, bool)
    a = b = 0
    for position, size in [*(divmod(x, 1 << 32) for x in sorted(spans)), (n, 0)]:
        if position >= b:
            gone[a:b] |= words[a:b].sum() >= stretch_words
            a = b = position
        b = max(b, position + size)
    return gone


def _cut(at_text: int, at_lost: int, stretch_words: int):
    def run(batches):
        for batch in batches:
            texts, lost = batch.column(at_text).cast(pa.string()), batch.column(at_lost)
            out, n_all, n_lost = [], [], []
            for first, body, offsets in tv.chunks(texts):
                starts, owner = sentence_starts(body, offsets)
                words = np.diff(np.searchsorted(tv.word_spans(body, offsets)[0], np.append(starts, len(body))))
                raw = body.tobytes()
                bounds = tv.row_bounds(owner, len(offsets) - 1)
                for i in range(len(offsets) - 1):
                    edges = np.append(starts[bounds[i] : bounds[i + 1]], offsets[i + 1])
                    n = len(edges) - 1
                    gone = _covered(lost[first + i].as_py() or [], n, words[bounds[i] : bounds[i + 1]], stretch_words)
                    n_all.append(n)
                    n_lost.append(int(gone.sum()))
                    if n_lost[-1]:
                        out.append(b"".join(raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(~gone)))
                    else:
                        out.append(raw[offsets[i] : offsets[i + 1]] if texts[first + i].is_valid else None)
            columns = [x for i, x in enumerate(batch.columns) if i != at_lost]
            columns[at_text] = pa.array(out, pa.binary()).cast(pa.string())
            names = [x for i, x in enumerate(batch.schema.names) if i != at_lost]
            yield pa.record_batch([*columns, pa.array(n_all, pa.int64()), pa.array(n_lost, pa.int64())], names=[*names, "__n_sentences", "__n_removed"])

    return run


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the stretches of min_words words or more that copies of runs cover, and __n_sentences and __n_removed."""
    return _deduped(docs, id_col, text_col, min_sentences, 0, min_words)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the sentences that later copies of spans cover, and __n_sentences and __n_removed."""
    return _deduped(docs, id_col, text_col, min_sentences, min_words, 0)


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_sentences: int, span_words: int, stretch_words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text")).where("row_id is not null")
    id_type = dict(rows.dtypes)["row_id"]
    spans = in_batches(rows, _spans(min_sentences, span_words), f"h1 long, h2 long, row_id {id_type}, place long, later boolean")
    # `later` comes last in the order, so that a copy by chance under the hash of others is no first.
    dealt = spans.repartition("h1").sortWithinPartitions("h1", "h2", "later", "row_id", "place")
    copies = in_batches(dealt, _copies, f"row_id {id_type}, place long")
    lost = copies.groupBy(F.col("row_id").alias("__row_id")).agg(F.collect_set("place").alias("__lost"))  # at most a document's spans
    joined = docs.join(lost.hint("merge"), F.col(id_col) == F.col("__row_id"), "left").drop("__row_id")
    fields = [T.StructField(x.name, T.StringType()) if x.name == text_col else x for x in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("__n_sentences", T.LongType()), T.StructField("__n_removed", T.LongType())])
    return in_batches(joined, _cut(docs.columns.index(text_col), len(docs.columns), stretch_words), schema)
