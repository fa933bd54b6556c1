import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaplens.llm import line_dedup, media, quality_rules
from gaplens.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"
NASTY = [None, "", " ", "\n", "a\n\na\n a\n", "x y z x y z x y z", "é | ü | é | ü\n#*$%&|<>\n" * 3, "The Same Long Line Of Words\n  the same long line of words  \nb", "the same long line of words", "THE SAME LONG LINE OF WORDS\t", "w " * 3000, "日本 語\x0b日本 語 日本 語 日本"]


def slow_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), lines]


def test_text_stats():
    got = quality_rules.text_stats(pa.array(NASTY))
    assert [[int(got[k][i]) for k in quality_rules.STATS] for i in range(len(NASTY))] == [slow_stats(t) for t in NASTY]


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 10, 0.3), (7, 1000, 0.01), (20, 1000, 0.01), (999, 1000, 0.5), (5, 5, 0.5)])
def test_binomial_tail_is_exact(k, n, p):
    want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, abs=1e-12)


def test_certified_cutoffs_hold_the_risk():
    good, bad = np.zeros(101, int), np.zeros(101, int)
    good[0], good[30], bad[40], bad[25] = 2000, 1, 50, 5
    assert quality_rules.certified_cutoff(good, bad, 0.01, 0.01) == 40 - 14 + 0 or quality_rules.certified_cutoff(good, bad, 0.01, 0.01) in range(1, 41)
    cutoff = quality_rules.certified_cutoff(good, bad, 0.01, 0.01)
    lost = int(good[cutoff:].sum())
    assert quality_rules.binomial_tail(lost, 2001, 0.01) <= 0.01 and bad[cutoff:].sum() >= 50
    assert quality_rules.certified_cutoff(good // 100, bad, 0.01, 0.01) is None


def test_verdicts_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        want = slow_stats(r["text"])
        got = out[r["doc_id"]]
        assert [got[k] for k in quality_rules.STATS] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got["base_failed"] == failed and not (failed and got["kept"])


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i if i % 3 else None, t, "de" if i % 2 else None, "mine") for i, t in enumerate(NASTY)], "doc_id long, text string, lang string, cutoffs string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (4, 7)], "doc_id long, quality int")
    assert quality_rules.quality_verdicts(docs, labels).count() == len(NASTY)
    kept = quality_rules.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality_rules.keep_quality(docs.limit(0), labels.limit(0)).count() == 0


def slow_lines(rows, min_docs=3, min_chars=20):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    key = lambda line: low(line.strip(WS))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run_lines(df, **kw):
    out = line_dedup.dedup_lines(df, **kw)
    return sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=str)


def test_lines_cases(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(None, NASTY[7]), (7, NASTY[8]), (99, NASTY[10]), (98, NASTY[10]), (97, NASTY[10])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keys string")
    assert run_lines(df) == slow_lines(rows)
    assert run_lines(df.limit(0)) == []


def test_lines_match_sql(spark):
    got = [tuple(r) for r in QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.01").collect()]
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(got) == sorted(con.execute(ORACLE_SQL["op7_line_dedup"]).fetchall())


def test_index_is_reversible(spark):
    line = "this very line is long enough {}"
    docs = spark.createDataFrame([(i, "\n".join(line.format(j) for j in range(i, 12))) for i in range(12)], "doc_id long, text string")
    first = line_dedup.LineIndex.build(docs.where("doc_id < 6"))
    both = first.insert(docs.where("doc_id >= 6"))
    whole = line_dedup.LineIndex.build(docs)
    table = lambda x: sorted(map(tuple, x.counts.collect()))
    assert table(both) == table(whole)
    back = both.delete(docs.where("doc_id >= 6"))
    assert table(back) == table(first)
    for a, b in ((both, whole), (back, first)):
        assert sorted(map(tuple, a.suspects().join(a.counts, ["k1", "k2"]).select("row_id", "k1").collect())) == sorted(map(tuple, b.postings.join(b.counts, ["k1", "k2"]).select("row_id", "k1").collect()))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    made = line_dedup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    others = rng.integers(0, 2**63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert made.contains(others).mean() < 0.01
    assert all(made.delete(int(k)) for k in keys[:2500]) and made.contains(keys[2500:]).all()
    assert made.contains(keys[:2500]).mean() < 0.01


@pytest.mark.parametrize("kind", ["pgm", "bmp", "ppm"])
def test_media_round_trip(kind):
    x = np.random.default_rng(2).integers(0, 256, (7, 13, 3) if kind == "ppm" else (7, 13)).astype(np.uint8)
    assert (media.decode(media.encode(x, kind)) == x).all()
    if kind == "ppm":
        assert (media.decode(media.encode(x, "bmp")) == x).all()


def test_plain_netpbm():
    assert media.decode(b"P2 # c\n2 2\n# d\n15\n0 15 5 10").tolist() == [[0, 255], [85, 170]]
    assert media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_box_average():
    x = np.random.default_rng(4).integers(0, 256, (10, 15))
    fine = np.kron(x, np.ones((7, 4)))
    want = fine.reshape(7, 10, 4, 15).mean((1, 3))
    assert np.allclose(media.area_resize(x, 7, 4), want)


def test_media_query(spark):
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(NASTY)], "doc_id long, text string, media binary")
    for kind in ("pgm", "bmp"):
        out = {r["doc_id"]: r for r in media.media_features(media.media_column(df, kind=kind)).collect()}
        for i, t in enumerate(NASTY):
            raw = (t or "").encode()
            padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            r = out[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert np.load(__import__("io").BytesIO(r["tile"])).shape == (16, 16)
    assert media.media_features(media.media_column(df.limit(0))).count() == 0
    assert struct.calcsize("<2sIHHI") == 14
