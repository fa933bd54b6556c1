"""SentencePiece encoding and decoding with N-best segmentation (operator 1).

The best segmentation maximises the sum of piece scores of a public model. Two
neighbouring characters that stand side by side in no piece are a certain boundary, so
a text falls into short units that are segmented once each: a Viterbi pass, vectorised
over all new units of a batch, gives the best path and the loss of the second best.
A text's N best segmentations differ from its best only in the N - 1 units of least
loss; each of those gets its own N best by a backward A* search over its piece lattice
with the forward Viterbi scores as exact heuristic, and the lists are merged best first,
scores and ids.

A character without a piece becomes its UTF-8 byte pieces at the cost the library sets
for unknown characters (ten below the least score). Normalisation is the identity with
a leading space, as in the model used; U+2581 in a text decodes to a space.

The public model is a BPE model: its scores are merge ranks, so the best sum of scores is the
optimum of this lattice and not the library's merge order. Ids decode to the same text,
but the library's own encoding of a text is as a rule another one.

Defined results: a null or empty text has no pieces, score 0 and one segmentation. Scores are
whole numbers, so sums are exact; of equal segmentations the one of fewer changes comes
first, then the one that changes earlier units, then the order of the search (see `nbest`).
A run of more than LONGEST_UNIT characters without a certain boundary is cut at that length,
each stretch segmented by itself. Repeated rows are encoded alike; other columns pass
through, those named as the results are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaplens.llm import textvec as tv
from gaplens.llm.common import in_batches

SPACE = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Units kept by a task before it starts afresh.
KNOWN_UNITS = 1_000_000
#: A run of more characters without a certain boundary is cut at this length, so that its lattice fits a worker.
LONGEST_UNIT = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Pairs of characters below this are looked up in a dense table.
NEAR = 0x250
_NONE = -1e300


@functools.cache
def _inverses(n: int) -> np.ndarray:
    step = np.full(max(1, n), _INVERSE, np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


class Pieces:
    """A model's pieces: hashed lookup, scores, bytes and the pairs of characters inside them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        self.score = np.array([model.get_score(i) for i in range(size)], np.float64)
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes((value,))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name] = i
                self.bytes_of[i] = name.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        self.unknown = float(min(self.score[i] for i in self.ids.values())) - 10
        self.pairs = np.array(sorted({ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.near = np.zeros((NEAR, NEAR), bool)
        a, b = self.pairs >> 21, self.pairs & ((1 << 21) - 1)
        inside = (a < NEAR) & (b < NEAR)
        self.near[a[inside], b[inside]] = True
        self.near = self.near.ravel()
        digits = len(str(max(0, size - 1))) + 1
        self.written = np.array([b"%d " % i for i in range(size)], f"S{digits}")
        self.n_written = np.array([len(b) for b in self.written.tolist()], np.int64)
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        self._tables(keys, np.fromiter(self.ids.values(), np.int64))

    @staticmethod
    def _hash(piece: str) -> int:
        u = np.array([ord(c) for c in piece], np.uint64)
        return int((tv.mix(u) * tv.powers(len(u))).sum(dtype=np.uint64))

    def _tables(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Open tables without chains: what finds its slot taken goes to the next table, and the slot says so."""
        self.tables = []
        while len(keys):
            bits = max(8, int(len(keys) * 8).bit_length())
            multiplier = np.uint64((2 * len(self.tables) + 1) * 0xD6E8FEB86659FD93 % 2**64)
            slot = ((keys * multiplier) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table_key, table_id, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            table_key[slot[first]], table_id[slot[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.tables.append((multiplier, np.uint64(64 - bits), table_key, table_id, more))
            keys, ids = keys[rest], ids[rest]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        shape, keys = keys.shape, keys.ravel()
        out, left = np.full(keys.shape, -1, np.int32), None
        for multiplier, shift, table_key, table_id, more in self.tables:
            slot = ((keys * multiplier) >> shift).astype(np.int64)
            hit = table_key[slot] == keys
            at = np.flatnonzero(hit)
            out[at if left is None else left[at]] = table_id[slot[at]]
            on = np.flatnonzero(more[slot] & ~hit)
            keys, left = keys[on], on if left is None else left[on]
            if not len(keys):
                break
        return out.reshape(shape)

    def joined(self, pair: np.ndarray) -> np.ndarray:
        """Whether two characters (a << 21 | b) stand side by side in some piece."""
        a, b = pair >> 21, pair & ((1 << 21) - 1)
        out = self.near[np.minimum(a, NEAR - 1) * NEAR + np.minimum(b, NEAR - 1)]
        far = np.flatnonzero((a >= NEAR) | (b >= NEAR))
        if len(far):
            place = np.minimum(np.searchsorted(self.pairs, pair[far]), len(self.pairs) - 1)
            out[far] = self.pairs[place] == pair[far]
        return out

    def text_of(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, a space after each."""
        return self.written[ids].tobytes().translate(None, b"\0")


@functools.cache
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


def edges_to(model: Pieces, unit: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
    """Edges (start, score, ids) that end at a position, the longest first."""
    out = []
    for start in range(max(0, end - model.longest), end):
        found = model.ids.get(unit[start:end])
        if found is not None:
            out.append((start, float(model.score[found]), (found,)))
    if unit[end - 1] not in model.ids:
        out.append((end - 1, model.unknown, tuple(int(model.byte_id[b]) for b in unit[end - 1].encode())))
    return out


def lattice(model: Pieces, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    return [[], *(edges_to(model, unit, end) for end in range(1, len(unit) + 1))]


def nbest(model: Pieces, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a unit, best first: backward A* under exact forward scores.

    Of equal scores the search follows first what has come nearest to the unit's start, then what it found first
    (the longest edge). A node is left n times at most: no n best paths need more, however many are equal.
    """
    forward = [0.0]
    for end in range(1, len(unit) + 1):
        forward.append(max(forward[s] + score for s, score, _ in edges_to(model, unit, end)))
    found: list[tuple[float, tuple[int, ...]]] = []
    heap: list[tuple[float, int, int, float, tuple]] = [(-forward[-1], len(unit), 0, 0.0, ())]
    left = [0] * (len(unit) + 1)
    count = 0
    while heap and len(found) < n:
        _, at, _, behind, tail = heapq.heappop(heap)
        if left[at] == n:
            continue
        left[at] += 1
        if at == 0:
            ids: list[int] = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            found.append((behind, tuple(ids)))
            continue
        for start, score, ids in edges_to(model, unit, at):
            count += 1
            heapq.heappush(heap, (-(forward[start] + score + behind), start, count, score + behind, (ids, tail)))
    return found


class Encoder:
    """Segments units once and remembers them, up to KNOWN_UNITS."""

    def __init__(self, model: Pieces, n: int):
        self.model, self.n = model, n
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.order = np.zeros(0, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.texts: dict[int, list[tuple[float, np.ndarray]]] = {}

    def encode(self, texts: list[str], digest: bool = False) -> list[tuple]:
        """(ids, scores) of the n best segmentations of each text; with `digest` (the best one's ids, scores, the digest of that one, of all)."""
        joined = "".join([SPACE + t.replace(" ", SPACE) for t in texts if t])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(codes):
            none = np.zeros(0, np.int32)
            empty = hashlib.sha256(b"").hexdigest()
            return [(none, [0.0], empty, empty) if digest else ([none], [0.0]) for _ in texts]
        pair = (codes[:-1].astype(np.int64) << 21) | codes[1:].astype(np.int64)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.model.joined(pair)
        cut[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        long = np.flatnonzero(np.diff(np.append(starts, len(codes))) > LONGEST_UNIT)
        for i in long:
            cut[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(codes) : LONGEST_UNIT] = True
        if len(long):
            starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(codes)))
        position = np.arange(len(codes)) - np.repeat(starts, lengths)
        hashed = tv.mix(codes)
        whole = tv.mix(np.add.reduceat(hashed * tv.powers(int(lengths.max()))[position], starts) + lengths.astype(np.uint64), 41)
        distinct, first, unit = np.unique(whole, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_UNITS:
            self._forget()
        self._learn(distinct, starts[first], lengths[first], codes, hashed)
        row = self.order[np.searchsorted(self.keys, distinct)]
        rows = row[unit]
        size = self.size[rows]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(self.at[rows], size)
        ids = self.flat[take]
        unit_bounds = np.searchsorted(starts, offsets)
        id_bounds = np.concatenate([[0], ends])[unit_bounds]
        losses = self.loss[rows]
        out = []
        for i in range(len(texts)):
            a, b = unit_bounds[i], unit_bounds[i + 1]
            mine = ids[id_bounds[i] : id_bounds[i + 1]]
            at = np.append(ends[a:b] - size[a:b], ends[b - 1] if b > a else 0) - id_bounds[i]
            best = float(self.score[rows[a:b]].sum()) if b > a else 0.0
            merged = self._merged(losses[a:b], rows[a:b], joined, starts[a:b], lengths[a:b])
            scores = [best - x for x, _ in merged]
            if digest:
                out.append((mine, scores, *self._digests(mine, at, rows[a:b], [changes for _, changes in merged])))
            else:
                out.append(([self._replaced(mine, at, rows[a:b], changes) for _, changes in merged], scores))
        return out

    def _digests(self, ids: np.ndarray, at: np.ndarray, rows: np.ndarray, every: list[tuple]) -> tuple[str, str]:
        """`ids_digest` of the first segmentation and `nbest_digest` of all; what they share is written once."""
        whole = self.model.text_of(ids)
        ends = np.concatenate([[0], np.cumsum(self.model.n_written[ids])]) if len(every) > 1 else None
        texts = []
        for changes in every:
            parts, done = [], 0
            for unit, choice in sorted(changes):
                parts += [whole[done : int(ends[at[unit]])], self.model.text_of(self.texts[int(rows[unit])][choice][1])]
                done = int(ends[at[unit + 1]])
            texts.append((b"".join(parts) + whole[done:] if parts else whole)[:-1])
        return hashlib.sha256(texts[0]).hexdigest(), hashlib.sha256(b"\n".join(texts)).hexdigest()

    def _merged(self, losses: np.ndarray, rows: np.ndarray, joined: str, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[float, tuple]]:
        """(loss against the best, ((unit, choice), ...)) of the n best: each unit of least loss takes one of its own n best."""
        k = min(self.n - 1, len(losses))
        sums: list[tuple[float, tuple]] = [(0.0, ())]  # ascending
        if k <= 0:
            return sums
        last = np.partition(losses, k - 1)[k - 1]
        near = np.flatnonzero(losses <= last)  # in order of their places; of those equal to the last, the first ones
        under = losses[near] < last
        least = np.sort(np.concatenate([near[under], near[~under][: k - int(under.sum())]]))
        for i in least:
            if losses[i] == np.inf:
                continue
            row = int(rows[i])
            if row not in self.texts:
                self.texts[row] = self._choices(row, joined[starts[i] : starts[i] + lengths[i]])
            options = [(a + b, c + ((int(i), j),) if j else c) for a, c in sums for j, (b, _) in enumerate(self.texts[row])]
            sums = sorted(options, key=lambda x: x[0])[: self.n]
        return sums

    def _choices(self, row: int, unit: str) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of a unit's n best; first the one of the Viterbi pass, which may share its score with others."""
        found = nbest(self.model, unit, self.n)
        at = self.at[row]
        first = tuple(self.flat[at : at + self.size[row]].tolist())
        rest = [(found[0][0] - score, np.array(ids, np.int32)) for score, ids in found if ids != first]
        return [(0.0, np.array(first, np.int32)), *rest][: self.n]

    def _replaced(self, ids: np.ndarray, at: np.ndarray, rows: np.ndarray, changes: tuple) -> np.ndarray:
        """A text's ids with other choices of some units; unit i has the ids from at[i] to at[i + 1]."""
        parts, done = [], 0
        for unit, choice in sorted(changes):
            parts += [ids[done : at[unit]], self.texts[int(rows[unit])][choice][1]]
            done = at[unit + 1]
        return np.concatenate([*parts, ids[done:]]) if parts else ids

    def _learn(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, hashed: np.ndarray) -> None:
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != keys)
        else:
            new = np.arange(len(keys))
        if not len(new):
            return
        new = new[np.argsort(lengths[new], kind="stable")]
        scores, losses, sizes, flats = [], [], [], []
        at = 0
        while at < len(new):
            longest = int(lengths[new[at]])
            room = max(1, 2_000_000 // (max(1, longest) * min(longest, self.model.longest)))
            part = new[at : at + room]
            part = part[lengths[part] == longest]
            at += len(part)
            got = self._segment(starts[part], longest, codes, hashed)
            for store, value in zip((scores, losses, sizes, flats), got, strict=True):
                store.append(value)
        size = np.concatenate(sizes)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *flats])
        self.score = np.concatenate([self.score, *scores])
        self.loss = np.concatenate([self.loss, *losses])
        every = np.concatenate([self.keys, keys[new]])
        rows = np.concatenate([self.order, len(self.order) + np.arange(len(new))])
        sort = np.argsort(every, kind="stable")
        self.keys, self.order = every[sort], rows[sort]

    def _segment(self, starts: np.ndarray, length: int, codes: np.ndarray, hashed: np.ndarray):
        """Best score, loss of the second best, number of ids and ids, for units of one length."""
        model, m = self.model, len(starts)
        wide = min(length, model.longest)
        chars = codes[starts[:, None] + np.arange(length)]
        prefix = np.zeros((m, length + 1), np.uint64)
        np.cumsum(hashed[starts[:, None] + np.arange(length)] * tv.powers(length), axis=1, out=prefix[:, 1:])
        score = np.full((m, length, wide), _NONE)  # of the edge from a start over 1, 2, ... characters
        piece = np.full((m, length, wide), -1, np.int32)
        back = _inverses(max(length, 64))
        for k in range(1, wide + 1):
            n = length - k + 1
            found = model.find((prefix[:, k:] - prefix[:, :n]) * back[:n])
            piece[:, :n, k - 1] = found
            score[:, :n, k - 1] = np.where(found >= 0, model.score[found], _NONE)
        lost = piece[:, :, 0] < 0
        score[:, :, 0][lost] = model.unknown
        forward = np.full((m, length + 1), _NONE)
        forward[:, 0] = 0
        chosen = np.zeros((m, length + 1), np.int64)
        for end in range(1, length + 1):
            k = np.arange(1, min(end, wide) + 1)
            options = forward[:, end - k] + score[:, end - k, k - 1]
            pick = options.argmax(1)
            chosen[:, end] = pick + 1
            forward[:, end] = options[np.arange(m), pick]
        backward = np.full((m, length + 1), _NONE)
        backward[:, length] = 0
        for start in range(length - 1, -1, -1):
            k = np.arange(1, min(length - start, wide) + 1)
            backward[:, start] = (backward[:, start + k] + score[:, start, k - 1]).max(1)
        best = forward[:, length]
        through = np.full((m, length, wide), _NONE)
        for k in range(1, wide + 1):
            n = length - k + 1
            through[:, :n, k - 1] = forward[:, :n] + score[:, :n, k - 1] + backward[:, k:]
        path = np.full((m, length), -2, np.int64)  # the piece that begins at a position of the best path
        at = np.full(m, length)
        live = np.arange(m)
        while len(live):
            k = chosen[live, at[live]]
            start = at[live] - k
            through[live, start, k - 1] = _NONE
            path[live, start] = piece[live, start, k - 1]
            at[live] = start
            live = live[start > 0]
        second = through.reshape(m, -1).max(1)
        loss = np.where(second > -1e200, best - second, np.inf)
        used = path != -2
        if not lost.any():
            return best, loss, used.sum(1), path[used].astype(np.int32)
        sizes, flat = [], []
        for i in range(m):
            ids: list[int] = []
            for j in np.flatnonzero(used[i]):
                ids += [int(path[i, j])] if path[i, j] >= 0 else [int(model.byte_id[b]) for b in chr(int(chars[i, j])).encode()]
            sizes.append(len(ids))
            flat += ids
        return best, loss, np.array(sizes, np.int64), np.array(flat, np.int32)


class Decoder:
    def __init__(self, model: Pieces):
        self.size = np.array([len(b) for b in model.bytes_of], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(model.bytes_of), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes without the leading space; control and unknown ids give nothing."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.arange(total) - np.repeat(ends - size, size) + np.repeat(self.at[ids], size)].tobytes()
        return out[1:] if out[:1] == b" " else out


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))


def _encode_batches(model_file: str, n: int, at_text: int, kept: list[int], digest: bool = False):
    names = list(DIGESTED if digest else ENCODED)

    def run(batches):
        encoder = Encoder(pieces(model_file), n)
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") < tv.CHUNK_BYTES):
                    chars += len(texts[upto] or "")
                    upto += 1
                found = encoder.encode([t or "" for t in texts[at:upto]], digest)
                best = _lists([x[0] if digest else x[0][0] for x in found])
                scores = pa.array([x[1] for x in found], pa.list_(pa.float64()))
                if digest:
                    columns = [best, scores, pa.array([x[2] for x in found]), pa.array([x[3] for x in found])]
                else:
                    sizes = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])]).astype(np.int32)
                    columns = [best, scores, pa.ListArray.from_arrays(pa.array(sizes), _lists([x for ids, _ in found for x in ids]))]
                rest = batch.slice(at, upto - at)
                yield pa.record_batch([*(rest.column(i) for i in kept), *columns], names=[*(rest.schema.names[i] for i in kept), *names])
                at = upto

    return run


def _decode_batches(model_file: str, at: int):
    def run(batches):
        decoder = Decoder(pieces(model_file))
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            texts = [decoder.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


ENCODED = {"ids": "array<int>", "nbest_scores": "array<double>", "nbest_ids": "array<array<int>>"}
DIGESTED = {"ids": "array<int>", "nbest_scores": "array<double>", "ids_sha256": "string", "nbest_sha256": "string"}


def encode_column(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE, n: int = N_BEST, digest: bool = False) -> DataFrame:
    """docs without the text, and ids array<int>, and best first nbest_scores array<double> and nbest_ids array<array<int>>.

    With `digest` the tasks that segment a text also hash its lists: ids_sha256 and nbest_sha256 (see `ids_digest`, `nbest_digest`) stand for nbest_ids.
    """
    made = DIGESTED if digest else ENCODED
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    kept = [i for i, c in enumerate(docs.columns) if c != text_col and c not in made]
    schema = ", ".join([f"`{c}` {t}" for c, t in (rows.dtypes[i] for i in kept)] + [f"{c} {t}" for c, t in made.items()])
    return in_batches(rows, _encode_batches(model_file, n, docs.columns.index(text_col), kept, digest), schema)


def decode_column(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """encoded and a column `decoded`; null ids decode to an empty text."""
    columns = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", decoded string"
    return in_batches(rows, _decode_batches(model_file, columns.index(ids_col)), schema)


def ids_digest(ids: str = "ids"):
    """SHA-256 of the ids, written in decimal and joined by spaces."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256)


def nbest_digest(nbest_ids: str = "nbest_ids"):
    """SHA-256 of the segmentations, each written as in ids_digest and joined by line feeds."""
    return F.sha2(F.array_join(F.transform(nbest_ids, lambda x: F.array_join(x.cast("array<string>"), " ")), "\n"), 256)
