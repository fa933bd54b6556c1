"""Conversation structure repair: the cheapest edits that give every talk the turns (s?(ua)+)? (operator 12).

The rows of a talk by turn are a chain; with what has been said so far (nothing, a
system row, a user row, an assistant row) it makes a graph of 4 nodes a row. Arcs keep
a row (0), change its role (3), delete it (4) or insert an empty one (3); a kept or
changed row that is truncated costs 3 more, a blank or repeated one must go. Costs are
whole and small, so distances to the end come from Dial's bucket queue; the audit is
the walk along tight arcs that takes the least letter of D, I, K, R at every node. From
a node each letter leads to one node only, so this is the ASCII-least of the cheapest.

Rows are dealt by ranges of (talk, turn, role, head of the text), which splits a talk of
any length. A task settles the talks that lie inside its range and hold at most LONGEST
rows and LONGEST_TEXT characters; equal row patterns share one search. The others (the
first and the last of each range, and long ones) are cut into segments. Of each one
search per way out gives a 4 x 4 table of costs; tables multiply (least sum), first
within a range, then over the ranges of a talk, so every segment learns its distances
to the end, walks from each of 4 entries, and the entries follow from the first segment
on. Only the SHA-256 of a long talk's text, which has no parallel form, reads its rows
in one task, as a stream.

Defined results: a null conv_id is a talk of its own; a null turn comes first and is no
turn for the gaps; null role and text are one space; rows of equal turn are ordered by
role and text, so a copy stands beside its original; the initial of an empty role is
empty and fits no place; empty tables give no rows; a talk without rows after damage
gives zeros, an empty audit and the hash of the empty string. Columns other than the
four are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.llm.common import in_batches, saved

# Costs of edits, and pairs of role initials that may follow each other.
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
#: A talk of at most so many rows and characters is settled at once; a segment has at most so many rows.
LONGEST, LONGEST_TEXT = 4096, 4 << 20
FAR = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
END = (0, FAR, FAR, 0)
#: Which states a row may follow, by the state it leads to.
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
LEADS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after an inserted or renamed row.
NEXT = (USER, USER, ASSISTANT, USER)
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage; copies is 0 for a dropped one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def fault(text: str) -> str:
    """b for blank, t for truncated, else k."""
    solid = text.strip(WHITE)
    return "b" if not solid else "k" if solid[-1] in ".!?" else "t"


def sign(role: str, code: str) -> str:
    """A row as the search sees it: its initial (o for any other), in capitals if truncated, x if it must go."""
    if code in "bd":
        return "x"
    initial = role[0] if role and role[0] in "sua" else "o"
    return initial.upper() if code == "t" else initial


def distances(signs: str, goal: tuple[int, ...]) -> list[int]:
    """Cost from every node 4 * row + state to the end, whose states cost `goal`: Dial's buckets, one a cost."""
    n = len(signs)
    dist = [FAR] * (4 * n + 4)
    least = min(goal)
    buckets: list[list[int]] = [[]]

    def reach(node: int, cost: int) -> None:
        if cost < dist[node]:
            dist[node] = cost
            while len(buckets) <= cost - least:
                buckets.append([])
            buckets[cost - least].append(node)

    for state, cost in enumerate(goal):
        if cost < FAR:
            reach(4 * n + state, cost)
    at = 0
    while at < len(buckets):
        cost = least + at
        for node in buckets[at]:  # arcs of cost 0 add to the bucket while it is read
            if dist[node] != cost:
                continue
            row, state = divmod(node, 4)
            if state in (USER, ASSISTANT):
                for before in BEFORE[state]:
                    reach(4 * row + before, cost + INSERT)
            if not row:
                continue
            reach(node - 4, cost + DELETE)
            s = signs[row - 1]
            if s == "x":
                continue
            more = TRUNCATED if s.isupper() else 0
            if state in (USER, ASSISTANT):
                for before in BEFORE[state]:
                    reach(4 * (row - 1) + before, cost + RETITLE + more)
            if LEADS.get(s.lower()) == state:
                for before in BEFORE[state]:
                    reach(4 * (row - 1) + before, cost + more)
        buckets[at] = []
        at += 1
    return dist


def walk(signs: str, dist: list[int], goal: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters along tight arcs from a state before the first row, and the state they end in."""
    out, row, n = [], 0, len(signs)
    while True:
        here = dist[4 * row + state]
        if row == n and here == goal[state]:
            return "".join(out), state
        into = NEXT[state]
        if row < n:
            s = signs[row]
            more = TRUNCATED if s.isupper() else 0
            if here == dist[4 * (row + 1) + state] + DELETE:
                out.append("D")
                row += 1
                continue
        if here == dist[4 * row + into] + INSERT:
            out.append("I")
            state = into
            continue
        lead = LEADS.get(s.lower(), NOTHING) if s != "x" else NOTHING
        if lead and state in BEFORE[lead] and here == dist[4 * (row + 1) + lead] + more:
            out.append("K")
            state = lead
        else:
            out.append("R")
            state = into
        row += 1


@lru_cache(maxsize=1 << 16)
def cheapest(signs: str) -> tuple[int, str]:
    """Cost and audit of a whole talk."""
    dist = distances(signs, END)
    return dist[0], walk(signs, dist, END, NOTHING)[0]


class Repair:
    """What the audit makes of rows, as a stream: counts and a running SHA-256."""

    def __init__(self) -> None:
        self.state, self.said, self.hash = NOTHING, False, hashlib.sha256()
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.last, self.rows = 0, None, 0
        self.low = self.high = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.said else "") + role + ":" + text).encode())
        self.said = True

    def see(self, turn: int | None, role: str, code: str) -> None:
        """Count a row; rows come by turn."""
        self.rows += 1
        if code in self.counts:
            self.counts[code] += 1
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low

    def edit(self, letter: str, role: str | None, text: str | None) -> bool:
        """Apply a letter; whether it used up the row."""
        if letter in "IR":
            self.state = NEXT[self.state]
            self.say("user" if self.state == USER else "assistant", "" if letter == "I" else text or "")
        elif letter == "K":
            self.state = LEADS[role[0]]
            self.say(role, text or "")
        return letter != "I"

    def result(self, cost: int, audit: str) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"], "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": self.hash.hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def settled(rows: list[tuple]) -> dict:
    """The result of a talk from all its rows (turn, role, text), in order."""
    seen: set[tuple[str, str]] = set()
    codes = []
    for _, role, text in rows:
        code = fault(text)
        codes.append("d" if code != "b" and (role, text) in seen else code)
        seen.add((role, text))
    cost, audit = cheapest("".join(sign(r[1], c) for r, c in zip(rows, codes, strict=True)))
    done = Repair()
    for (turn, role, _), code in zip(rows, codes, strict=True):
        done.see(turn, role, code)
    at = 0
    for letter in audit:
        role, text = rows[at][1:] if at < len(rows) else (None, None)
        at += done.edit(letter, role, text)
    return done.result(cost, audit)


def _first_pass(kind: pa.Schema, longest: int, longest_text: int):
    """Sorted rows to results of the talks inside this range, and to numbered rows of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        text_held, pos, now, is_open, size = 0, 0, None, True, 0
        begun = False

        def spill() -> None:
            nonlocal pos, text_held, size
            for turn, role, text in held:
                gone = role is None
                code = "g" if gone else fault(text)
                digest = None if gone else hashlib.md5(f"{role}\0{text}".encode()).hexdigest()
                out.append({"conv_id": now, "part": part, "seg": pos // longest, "pos": pos, "turn": turn, "role": role, "text": None if code == "b" else text, "code": code, "digest": digest})
                pos += 1
            size += text_held
            held.clear()
            text_held = 0

        def close(last: bool) -> None:
            nonlocal text_held, size
            if not begun:
                return
            if is_open or last:
                spill()
            else:
                out.append({"conv_id": now, "part": -1, **settled([r for r in held if r[1] is not None])})
                size += 200
                held.clear()
                text_held = 0

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    first = not begun
                    close(False)
                    now, is_open, begun = conv, first, True  # the range before this one may hold more of its first talk
                if copies:
                    for _ in range(copies):
                        held.append((turn, role, text))
                        text_held += len(text)
                else:
                    held.append((None, None, None))
                if len(held) > longest or text_held > longest_text:
                    is_open = True
                if is_open and (len(held) >= 256 or text_held > 1 << 18):
                    spill()
                if size > 1 << 21 or len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, size = [], 0
        close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def _table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's signs and codes, and its 4 x 4 costs from entry to exit."""
    rows = rows[rows.code != "g"].sort_values("pos")
    signs = "".join(sign(r, c) for r, c in zip(rows.role, rows.code, strict=True))
    costs = np.full((4, 4), FAR, np.int64)
    for out in range(4):
        costs[:, out] = distances(signs, tuple(0 if s == out else FAR for s in range(4)))[:4]
    return pd.DataFrame({"cid": [key[0]], "part": [key[1]], "seg": [key[2]], "signs": [signs], "codes": ["".join(rows.code)], "costs": [costs.ravel().tolist()]})


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def _costs(column: pd.Series) -> list[np.ndarray]:
    return [np.array(x, np.int64).reshape(4, 4) for x in column]


def _joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The costs of a talk's segments of one range together."""
    tables = _costs(rows.sort_values("seg").costs)
    total = tables[0]
    for t in tables[1:]:
        total = _product(total, t)
    return pd.DataFrame({"cid": [key[0]], "part": [key[1]], "costs": [total.ravel().tolist()]})


def _ends(order: str, goal: str | None):
    """Costs to the talk's end after each of the rows, from the last one back; `goal` names what the last one's are."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        after = np.array(rows[goal].iloc[0] if goal else END, np.int64)
        found = []
        for t in reversed(_costs(rows.costs)):
            found.append(after.tolist())
            after = np.minimum((t + after[None, :]).min(1), FAR)
        out = rows[["cid", "part", *([order] if order != "part" else [])]].copy()
        out["goal"] = found[::-1]
        return out

    return run


def _walked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's audit and exit from each entry, and its entry's cost where it is the talk's first."""
    signs, goal = rows.signs.iloc[0], tuple(int(x) for x in rows.goal.iloc[0])
    dist = distances(signs, goal)
    walks = [walk(signs, dist, goal, s) if dist[s] < FAR else ("", s) for s in range(4)]
    return pd.DataFrame({"cid": [key[0]], "part": [key[1]], "seg": [key[2]], "codes": rows.codes, "audits": [[w[0] for w in walks]], "exits": [[w[1] for w in walks]], "cost": [dist[0]]})


def _entries(order: str, start: str | None):
    """The state each of the rows is entered in, from the first one on, and what they do together."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        state = int(rows[start].iloc[0]) if start else NOTHING
        found = []
        for exits in rows.exits:
            found.append(state)
            state = int(exits[state])
        out = rows[["cid", "part", *([order] if order != "part" else [])]].copy()
        out["entry"] = found
        return out

    return run


def _through(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Where each entry into a talk's segments of one range comes out."""
    states = list(range(4))
    for exits in rows.sort_values("seg").exits:
        states = [int(exits[s]) for s in states]
    return pd.DataFrame({"cid": [key[0]], "part": [key[1]], "exits": [states]})


def _last_pass(kind: pa.Schema):
    """Segments, each before its rows, in order of their talk, to one result a talk; holds one segment's letters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = conv = done = None
        audits: list[str] = []
        cost, codes, letters, seen, at = 0, "", "", 0, 0

        def rest() -> None:
            nonlocal at
            while done is not None and at < len(letters):
                done.edit(letters[at], None, None)
                at += 1

        def result() -> pa.RecordBatch:
            rest()
            return pa.RecordBatch.from_pylist([{"conv_id": conv, **done.result(cost, "".join(audits))}], kind)

        for batch in batches:
            for cid, conv_id, pos, turn, role, text, code, audit, given, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != now:
                    if done is not None:
                        yield result()
                    now, done, audits, cost, letters, at = cid, Repair(), [], price, "", 0
                if pos < 0:  # the segment's own row
                    rest()
                    audits.append(audit)
                    codes, letters, seen, at = given, audit, 0, 0
                    continue
                conv = conv_id
                if code == "g":
                    continue
                done.see(turn, role, codes[seen])
                seen += 1
                while at < len(letters):  # inserted rows stand before the row that uses up a letter
                    at += 1
                    if done.edit(letters[at - 1], role, text):
                        break
        if done is not None:
            yield result()

    return run


def _stretched(rows: DataFrame, conv_type: str) -> DataFrame:
    """Results of talks that lie in several ranges or are long, from their numbered rows."""
    rows = rows.withColumn("cid", F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    keys = rows.select("cid", "part", "seg", "pos", "role", "code", "digest")
    place = F.struct("part", "pos")
    first = keys.where("digest is not null").groupBy("cid", "digest").agg(F.min(place).alias("first"))
    known = keys.join(first, ["cid", "digest"], "left").withColumn("code", F.when((F.col("code") != "b") & (F.col("first") < place), "d").otherwise(F.col("code")))
    by_segment, by_part = ["cid", "part", "seg"], ["cid", "part"]
    tables = saved(known.groupBy(*by_segment).applyInPandas(_table, "cid string, part int, seg long, signs string, codes string, costs array<long>"))
    parts = tables.groupBy(*by_part).applyInPandas(_joined, "cid string, part int, costs array<long>")
    part_ends = parts.groupBy("cid").applyInPandas(_ends("part", None), "cid string, part int, goal array<long>")
    ends = tables.join(part_ends, by_part).groupBy(*by_part).applyInPandas(_ends("seg", "goal"), "cid string, part int, seg long, goal array<long>")
    walks = saved(tables.join(ends, by_segment).groupBy(*by_segment).applyInPandas(_walked, "cid string, part int, seg long, codes string, audits array<string>, exits array<int>, cost long"))
    through = walks.groupBy(*by_part).applyInPandas(_through, "cid string, part int, exits array<int>")
    part_entries = through.groupBy("cid").applyInPandas(_entries("part", None), "cid string, part int, entry int")
    entries = walks.join(part_entries, by_part).groupBy(*by_part).applyInPandas(_entries("seg", "entry"), "cid string, part int, seg long, entry int")
    none = lambda kind: F.lit(None).cast(kind)
    pieces = walks.join(entries, by_segment).select(
        "cid", "part", "seg", none(conv_type).alias("conv_id"), F.lit(-1).cast("long").alias("pos"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("code"),
        F.col("audits")[F.col("entry")].alias("audit"), "codes", "cost",
    )
    own = rows.select("cid", "part", "seg", "conv_id", "pos", F.col("turn").cast("long").alias("turn"), "role", "text", "code", none("string").alias("audit"), none("string").alias("codes"), none("long").alias("cost"))
    ordered = own.unionByName(pieces).repartition("cid").sortWithinPartitions("cid", "part", "seg", "pos")
    return in_batches(ordered.select("cid", "conv_id", "pos", "turn", "role", "text", "code", "audit", "codes", "cost"), _last_pass(_arrow(f"conv_id {conv_type}, {RESULT}", rows)), f"conv_id {conv_type}, {RESULT}")


def _arrow(schema: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def repair_conversations(rows: DataFrame, damage: bool = True, longest: int = LONGEST, longest_text: int = LONGEST_TEXT) -> DataFrame:
    """One row a talk: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Without damage the rows are judged as they are."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    given = damaged(rows) if damage else rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text, F.lit(1).alias("copies"))
    conv_type, turn_type = (dict(given.dtypes)[c] for c in ("conv_id", "turn"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    dealt = given.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    schema = f"conv_id {conv_type}, {RESULT}, part int, seg long, pos long, turn {turn_type}, role string, text string, code string, digest string"
    found = saved(in_batches(dealt, _first_pass(_arrow(schema, rows), longest, longest_text), schema))
    whole = found.where("part < 0").select("conv_id", *[c.split()[0] for c in RESULT.split(", ")])
    return whole.unionByName(_stretched(found.where("part >= 0").select("conv_id", "part", "seg", "pos", "turn", "role", "text", "code", "digest"), conv_type))
