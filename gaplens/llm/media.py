"""Media columns: Netpbm and BMP images, area resizing and difference hashes (operator 10).

`encode` writes 8-bit samples as binary PGM, PPM or BMP; `decode` reads binary and plain
PBM, PGM and PPM and uncompressed 8- or 24-bit BMP into arrays. Features come from
decoded samples: an area-averaged tile by integral images, kept as NPY bytes, and a
64-bit difference hash of a 9 x 8 reduction.

Defined results: a null or empty text is stored as one block of 64 zero bytes; equal
texts give equal bytes and features; every other column passes through, null ids too, and
those named as the results are replaced. A null file has no features and the error 'null';
one that cannot be decoded has its length, its digest and the error, and the job goes on.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaplens.llm.common import in_batches

BLOCK = 64
TILE = 16


def encode(samples: np.ndarray, kind: str = "pgm") -> bytes:
    """8-bit samples (height, width) or (height, width, 3) as a binary file."""
    height, width = samples.shape[:2]
    if kind in ("pgm", "ppm"):
        magic = b"P6" if samples.ndim == 3 else b"P5"
        return b"%s\n%d %d\n255\n" % (magic, width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()
    channels = 3 if samples.ndim == 3 else 1
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if channels == 1 else b""
    stride = (width * channels + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * channels] = (samples[..., ::-1] if channels == 3 else samples).reshape(height, -1)
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    head += struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 * channels, 0, rows.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + rows[::-1].tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows[:, : 3 * width].reshape(-1, width, 3)[..., ::-1]
    colours = np.frombuffer(data, np.uint8, start - 54, 54).reshape(-1, 4)[:, 2::-1]
    if (colours == colours[:, :1]).all():
        return rows[:, :width] if (colours[:, 0] == np.arange(len(colours))).all() else colours[:, 0][rows[:, :width]]
    return colours[rows[:, :width]]


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = int(data[1:2])
    fields, at = [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    shape = (height, width, 3) if channels == 3 else (height, width)
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1), axis=1)
        return (1 - bits[:, :width]) * np.uint8(255)
    if kind > 4:
        return _scaled(np.frombuffer(data, np.uint8 if top < 256 else ">u2", height * width * channels, at + 1).reshape(shape), top)
    text = data[at:].split() if kind != 1 else [bytes((x,)) for x in data[at:] if not bytes((x,)).isspace()]
    values = np.array([int(x) for x in text[: height * width * channels]], np.int64).reshape(shape)
    return ((1 - values) * 255).astype(np.uint8) if kind == 1 else _scaled(values, top)


def _scaled(values: np.ndarray, top: int) -> np.ndarray:
    return values if top == 255 else ((values.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box averages: the integral image, linear between its points, is exact for any box."""
    h, w = samples.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(samples, 0, dtype=np.int64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])

    def at(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        low = np.minimum(where.astype(np.int64), len(values) - 2)
        part = (where - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    grid = at(at(total, ys).T, xs).T
    return np.diff(np.diff(grid, axis=0), axis=1) / ((h / height) * (w / width))


def grey(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else (samples.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def difference_hash(samples: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 neighbours in a 9 x 8 reduction grows to the right."""
    small = np.round(area_resize(grey(samples), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(samples: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    tile = np.clip(np.rint(np.round(area_resize(grey(samples), size, size), 6)), 0, 255)
    np.save(out, np.ascontiguousarray(tile, np.uint8))
    return out.getvalue()


def _store(kind: str, at_text: int, kept: list[int]):
    def run(batches):
        for batch in batches:
            sizes, files = [], []
            for x in batch.column(at_text).cast(pa.string()):
                text = x.as_buffer() if x.is_valid else b""
                body = np.frombuffer(text, np.uint8)
                padded = np.zeros(max(1, -(-len(body) // BLOCK)) * BLOCK, np.uint8)
                padded[: len(body)] = body
                sizes.append(len(body))
                files.append(encode(padded.reshape(-1, BLOCK), kind))
            names = batch.schema.names
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[*(names[i] for i in kept), *STORED])

    return run


def _features(media: bytes) -> tuple:
    samples = decode(media)
    if not samples.size:
        raise ValueError("no samples")
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples), npy_tile(samples), None)


def _read(at_media: int, kept: list[int]):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in READ]
            for x in batch.column(at_media):
                media = x.as_py()
                try:
                    values = (None,) * 7 + ("null",) if media is None else _features(media)
                except (ValueError, IndexError, struct.error, OverflowError, MemoryError) as e:  # one broken file is no reason to lose the job
                    values = (None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, None, f"{type(e).__name__}: {e}"[:200])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            names = batch.schema.names
            yield pa.record_batch([*(batch.column(i) for i in kept), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]], names=[*(names[i] for i in kept), *READ])

    return run


STORED = {"n_bytes": "long", "media": "binary"}
READ = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile": "binary", "error": "string"}


def _schema(df: DataFrame, kept: list[int], added: dict[str, str]) -> str:
    return ", ".join([f"`{df.columns[i]}` {df.dtypes[i][1]}" for i in kept] + [f"{c} {t}" for c, t in added.items()])


def media_column(docs: DataFrame, text_col: str = "text", kind: str = "pgm") -> DataFrame:
    """docs without the text, and n_bytes and media, the stored file: the text's UTF-8 bytes, zero-padded to rows of 64 samples."""
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    kept = [i for i, c in enumerate(rows.columns) if c != text_col and c not in STORED]
    return in_batches(rows, _store(kind, rows.columns.index(text_col), kept), _schema(rows, kept, STORED))


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media without the files, and digests and features from the bytes read back; `tile` holds an NPY file."""
    kept = [i for i, c in enumerate(media.columns) if c != media_col and c not in READ]
    return in_batches(media, _read(media.columns.index(media_col), kept), _schema(media, kept, READ))
