"""HTML extraction by wrappers: union-free regular expressions inferred per host (operator 6).

A page is read as a stream of block tags and text; inline tags are transparent. Its blocks
become an expression: equal neighbours fold into a repeated group, and blocks that alternate
into a repeated group of optional members, so no list holds a key twice. The expressions of
all different pages of a host are aligned one after another, in tasks that each fold a bucket
of pages in the order of a hash and then the buckets: blocks that only some pages have
become optional groups, texts that differ become slots. Texts that half of a host's pages or
more have (MIN_PAGES at least) are counted beforehand and keep blocks of their own in the
alignment, so a constant line never vanishes in a repeated group of slots.

The wrapper decides what is main text. From the root it goes down while one group holds
HEAVY of the slot text that is no furniture, and stops at an article or main element, where
the rest bears headings, or where only text blocks are left. The path found is the main
region of the host's pages, on pages that have it; any other page goes by the wrapper of
itself. In the region, texts that the wrapper holds fixed (on nine tenths of the pages) are
cut, unless they make up more than a fifth of it: then the pages are copies of each other
and no template. Tags and class words are tie-breakers: menus, footers, sidebars, notices,
adverts, forms and reader comments go where an element's tag is one of FURNITURE, or a
container has one of WORDS as a whole class, id or role.

White space is Unicode white space, collapsed after character references are decoded.
Defined results: a null or empty page has empty text; unclosed and stray tags close
at the next block or are ignored; a null or malformed url belongs to host ''; equal pages
of a host count once; blocks deeper than DEEPEST count for the block at that depth in the
wrapper, their text stays; other columns pass through, one named `text` is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaplens.llm.common import in_batches, released, saved, small

MIN_PAGES = 4
HEAVY = 0.6
DEEPEST = 60
#: Different keys in one list; beyond them the tag alone is the key.
MOST_KEYS = 50
#: Pages to a bucket of the first folding, and buckets to one of the next.
BUCKET = 4096
FAN = 64
#: Attributes by their quotes, in bounded pieces; failing that a tag ends at its first '>', so reading a page takes time in proportion to it.
_QUOTED = r"""(?:[^'">]{1,512}+|"[^"]{0,2048}+"|'[^']{0,2048}+'){0,64}+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|button)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)({_QUOTED})>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_REST = re.compile("(?s).+()()()()()()()")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Block elements, and tags and class words of furniture.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset(("hr",))
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd option".split())
FURNITURE = frozenset("head title nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("div section ul ol dl table center details summary main figure fieldset address".split())
WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside notice notices cookie cookies consent "
    "popup modal newsletter subscribe share social related comment comments replies disqus search login pagination contentinfo complementary".split()
)
ADVERTS = frozenset("ad ads advert advertisement sponsored promo".split())
LOOSE = frozenset("header side notice notices share social related navigation menu masthead banner sponsor ad ads promo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))


def _marked(tag: str, words: list[str]) -> bool:
    """Whether a block of this tag and these class words is furniture by itself.

    Words count whole; of one joined by - or _ the first and the last part do, but for those that also name parts of an
    article (LOOSE) beside a word that is none of WORDS. Any block may be an advert; `side` says something only alone.
    """
    if tag in FURNITURE:
        return True
    named = {w for w in words if w != "side" or len(words) == 1}
    joined = [re.split("[-_]+", w) for w in words if "-" in w or "_" in w]
    named |= {p for parts in joined for p in (parts[0], parts[-1]) if p not in LOOSE or WORDS.issuperset(parts)}
    return not ADVERTS.isdisjoint(named) or (tag in CONTAINERS and not WORDS.isdisjoint(named))


class Block:
    __slots__ = ("children", "key", "linked", "marked", "tag")

    def __init__(self, tag: str, marks: str = ""):
        words = marks.lower().split()
        self.tag, self.marked = tag, _marked(tag, words)
        self.key = ".".join([tag, *(w for w in words if not any(c.isdigit() for c in w))])
        self.children: list[Block | str] = []
        self.linked = 0  # characters of its own texts in links


def _tokens(page: str) -> Iterator[re.Match]:
    """Tokens up to the last '>', behind which no tag ends, and what is left as one text unless a comment or script is open there."""
    end = page.rfind(">") + 1
    last = None
    for last in _TOKEN.finditer(page, 0, end):
        yield last
    raw = last is not None and (last.group(1) or last.group(0).startswith("<!--"))
    if raw and not re.search(r"(?:-->|</[a-zA-Z]+\s*>)\Z", last.group(0)[-24:]):
        return
    yield from _REST.finditer(re.split(r"<!--|<(?:script|style|noscript|template|svg|iframe|textarea|select|button)\b", page[end:], maxsplit=1, flags=re.I)[0])


def parse(page: str) -> Block:
    """The tree of blocks; children are blocks and non-empty texts in page order."""
    root = Block("")
    stack = [root]
    pending: list[str] = []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            stack[-1].children.append(text)
            stack[-1].linked += min(linked, len(text))
        linked = 0

    for m in _tokens(page):
        closes, tag, given = (m.group(2), m.group(3), m.group(4)) if m.group(3) else m.group(5, 6, 7)
        if not tag:
            token = m.group(0)
            if m.group(1) or token.startswith("<!--"):
                pending.append(" ")
            elif not token.startswith(("<!", "<?")):
                pending.append(token)
                linked += len(token) if in_link else 0
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not closes
        if tag == "br":
            pending.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        while stack[-1].tag in LEAF and (stack[-1].tag == tag or tag not in ("ul", "ol", "dl", "p", "table", "div") or stack[-1].tag == "p"):
            stack.pop()
        marks = " ".join(a or b or c for a, b, c in _MARK.findall(given)) if "=" in given else ""
        block = Block(tag, marks)
        stack[-1].children.append(block)
        if tag not in VOID and not given.endswith("/"):
            stack.append(block)
    flush()
    return root


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


Node = dict[str, Any]


def skeleton(page: Block, constant: frozenset[int] = frozenset()) -> Node:
    """A page as an expression. k key, n pages, m characters of text, a of them in links, o optional, r repeated, c children;
    texts have the key '#' and t, their hash, null for a slot. Blocks of one constant text have it in their key."""
    done: dict[int, Node] = {}
    work: list[tuple[Block, int, bool]] = [(page, 0, False)]
    while work:
        block, depth, ready = work.pop()
        if not ready and depth < DEEPEST:
            work.append((block, depth, True))
            work += [(x, depth + 1, False) for x in block.children if not isinstance(x, str)]
            continue
        kids: list[Node] = []
        if depth < DEEPEST:
            for child in block.children:
                kids.append(_text(child) if isinstance(child, str) else done.pop(id(child)))
            linked = block.linked
        else:
            texts, linked = _below(block)
            kids = [_text(x) for x in texts]
        node = {"k": block.key, "n": 1, "m": sum(x["m"] for x in kids), "a": linked + sum(x["a"] for x in kids), "c": kids}
        if len(kids) == 1 and kids[0]["k"] == "#" and kids[0]["t"] in constant:
            node["k"] = f"{block.key}={kids[0]['t']}"
        if len({x["k"] for x in kids}) > MOST_KEYS:
            for x in kids:
                x["k"] = re.split(r"[.=]", x["k"])[0]
        node["c"] = _listed(kids)
        done[id(block)] = node
    return done[id(page)]


def _text(text: str) -> Node:
    return {"k": "#", "n": 1, "m": len(text), "a": 0, "t": text_hash(text), "c": []}


def _below(block: Block) -> tuple[list[str], int]:
    texts, linked, work = [], 0, [block]
    while work:
        block = work.pop()
        linked += block.linked
        texts += [x for x in block.children if isinstance(x, str)]
        work += [x for x in reversed(block.children) if not isinstance(x, str)]
    return texts, linked


def _listed(kids: list[Node]) -> list[Node]:
    """Children of one page without a key twice: equal neighbours become a repeated group, what alternates one of optional members."""
    out: list[Node] = []
    for node in kids:
        if out and node["k"] == out[-1]["k"]:
            out[-1] = _joined(out[-1], node, 1) | {"r": True}
        else:
            out.append(node)
    return _grouped(out, 1)


def _grouped(kids: list[Node], pages: int) -> list[Node]:
    """The span from a key's first to its last place, for all keys in it twice, as one repeated group of optional members."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(kids):
        places.setdefault(x["k"], []).append(i)
    twice = [p for p in places.values() if len(p) > 1]
    if not twice:
        return kids
    a, b = min(p[0] for p in twice), max(p[-1] for p in twice)
    members = _pooled([y for x in kids[a : b + 1] for y in (x["c"] if x["k"] == "*" else [x])], pages)
    group = {"k": "*", "n": pages, "m": sum(x["m"] for x in members), "a": sum(x["a"] for x in members), "r": True, "c": members}
    return [*kids[:a], group, *kids[b + 1 :]]


def _pooled(nodes: list[Node], pages: int | None) -> list[Node]:
    """Members of a group: one of each key, in the order of first places."""
    members: dict[str, Node] = {}
    for y in nodes:
        members[y["k"]] = (_joined(members[y["k"]], y, pages) if y["k"] in members else y) | {"o": True}
    return list(members.values())


def _joined(a: Node, b: Node, pages: int | None = None) -> Node:
    """The least expression that both match; pages: of which both are parts, where they are of the same."""
    kids = _pooled([*a["c"], *b["c"]], pages) if a["k"] == "*" else _aligned(a["c"], b["c"], pages)
    out = {"k": a["k"], "n": a["n"] + b["n"] if pages is None else pages, "m": a["m"] + b["m"], "a": a["a"] + b["a"], "c": kids}
    if a["k"] == "#":
        out["t"] = a["t"] if a["t"] == b["t"] else None
    return out | {flag: True for flag in ("o", "r") if a.get(flag) or b.get(flag)}


def _aligned(left: list[Node], right: list[Node], pages: int | None) -> list[Node]:
    if not left or not right:
        return [x | {"o": True} for x in left or right]
    mixed = {y["k"] for x in [*left, *right] if x["k"] == "*" for y in x["c"]}
    if mixed:
        left, right = _absorbed(left, mixed), _absorbed(right, mixed)
    out: list[Node] = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, [x["k"] for x in left], [x["k"] for x in right], autojunk=False).get_opcodes():
        if op == "equal":
            out += [_joined(x, y, pages) for x, y in zip(left[i1:i2], right[j1:j2], strict=True)]
        else:
            out += [x | {"o": True} for x in [*left[i1:i2], *right[j1:j2]]]
    return _grouped(out, max(x["n"] for x in out))


def _absorbed(kids: list[Node], mixed: set[str]) -> list[Node]:
    """The run of members in a list becomes a group."""
    out: list[Node] = []
    for x in kids:
        if x["k"] in mixed:
            x = {"k": "*", "n": x["n"], "m": x["m"], "a": x["a"], "r": True, "c": [x | {"o": True}]}
        if x["k"] == "*" and out and out[-1]["k"] == "*":
            out[-1] = _joined(out[-1], x, max(out[-1]["n"], x["n"]))
        else:
            out.append(x)
    return _grouped(out, max(x["n"] for x in out))


def aligned(a: Node, b: Node) -> Node:
    """The wrapper of the pages of both."""
    return _joined(a, b)


def plan(wrapper: Node) -> dict[str, Any]:
    """path: keys from the root to the main region; drop: keys of its children that are no part of it; fixed: hashes of texts to cut."""
    if wrapper["n"] < MIN_PAGES:
        return {"path": _main_path(wrapper), "drop": [], "fixed": []}
    node, path, drop = wrapper, [], []
    while True:
        kids = _members(node)
        slots = [x for x in kids if not _furniture(x["k"]) and "=" not in x["k"]]
        total = sum(x["m"] for x in slots)
        blocks = [x for x in slots if x["k"] != "#" and _tag(x["k"]) not in LEAF]
        best = max(blocks, key=lambda x: x["m"] * (4 if _tag(x["k"]) in MAIN else 1), default=None)
        if best is None or not best["m"] or (_tag(best["k"]) not in MAIN and best["m"] < HEAVY * total):
            break
        if _tag(node["k"]) in MAIN and _tag(best["k"]) not in MAIN:
            break
        if _tag(best["k"]) not in MAIN and any(_tag(x["k"]) in HEADINGS for x in slots):
            break  # a title beside the text belongs to it
        node, path = best, [*path, best["k"]]
    if path and _tag(node["k"]) not in MAIN:
        wanted = [x["k"] for x in slots if (x["k"] == "#" or _tag(x["k"]) in LEAF or 10 * x["m"] >= total) and 10 * x["a"] <= 6 * max(x["m"], 1)]
        drop = sorted({x["k"] for x in slots} - set(wanted))
    fixed, mass, work = [], 0, [node] if not path or _tag(path[-1]) not in MAIN else []  # an article's lines are its own, whatever its neighbours say
    while work:
        x = work.pop()
        if "=" in x["k"] and 10 * x["n"] >= 9 * wrapper["n"] and wrapper["n"] >= MIN_PAGES:
            fixed.append(int(x["k"].rsplit("=", 1)[1]))
            mass += x["m"]
        work += x["c"]
    return {"path": path, "drop": drop, "fixed": sorted(fixed) if 5 * mass <= node["m"] else []}


def _members(node: Node) -> list[Node]:
    return [y for x in node["c"] for y in (x["c"] if x["k"] == "*" else [x])]


def _main_path(wrapper: Node) -> list[str]:
    """The path to the article or main element of most text; none where there is none."""
    best: tuple[int, list[str]] = (0, [])
    work: list[tuple[Node, list[str]]] = [(wrapper, [])]
    while work:
        node, path = work.pop()
        if path and _tag(path[-1]) in MAIN and node["m"] > best[0]:
            best = node["m"], path
        work += [(x, [*path, x["k"]]) for x in _members(node) if x["k"] != "#" and not _furniture(x["k"]) and "=" not in x["k"]]
    return best[1]


def _tag(key: str) -> str:
    return re.split(r"[.=]", key, maxsplit=1)[0]


def _furniture(key: str) -> bool:
    words = key.split("=", 1)[0].split(".")
    return _marked(words[0], words[1:])


def main_text(page: str | None, given: dict[str, Any] | None = None) -> str:
    """The main text of a page by a wrapper's plan; by its own where it has none or lacks the plan's path."""
    if not page:
        return ""
    root = parse(page)
    found = _at(root, given["path"]) if given else []
    if not found:
        given = plan(skeleton(root))
        found = _at(root, given["path"])
    fixed, drop = set(given["fixed"]), set(given["drop"])
    out: list[str] = []
    for region in found:
        work: list[Block | str] = [x for x in reversed(region.children) if ("#" if isinstance(x, str) else x.key) not in drop]
        while work:
            item = work.pop()
            if isinstance(item, str):
                if not fixed or text_hash(item) not in fixed:
                    out.append(item)
            elif not item.marked or (region.tag in MAIN and _titles(item)):
                work += reversed(item.children)
    return "\n".join(out)


def _titles(block: Block) -> bool:
    """A header of the article itself: the tag, or a block named so that holds its title."""
    return block.tag == "header" or ("header" in block.key.split(".")[1:] and any(not isinstance(x, str) and x.tag in ("h1", "h2") for x in block.children))


def _at(root: Block, path: list[str]) -> list[Block]:
    found = [root]
    for key in path:
        found = [x for block in found for x in block.children if not isinstance(x, str) and (x.key == key or x.tag == key)]
    return found


def _constants(batches):
    """(host, page, text) once for each text of a page; a page is known by its hash."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, h, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            texts = {text_hash(x) for x in _below(parse(page))[0]}
            for column, values in zip(out, ([host] * len(texts), [h] * len(texts), texts), strict=True):
                column += values
        yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["host", "h", "text"])


def _skeletons(batches):
    """(host, h, wrapper) of each different page; a task gives most equal pages once."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, h, page, constant in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (host, h) in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add((host, h))
            values = host, h, json.dumps(skeleton(parse(page), frozenset(constant or ())), separators=(",", ":"))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["host", "h", "wrapper"])


def _wrapped(batches):
    """(host, h, wrapper): the rows of each host and bucket aligned one after another; they come by host, bucket and h."""
    now, last, held = None, None, None
    for batch in batches:
        hosts, hs, buckets, texts = [], [], [], []
        for host, h, wrapper, bucket in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now == (host, bucket):
                if h != last:
                    held = aligned(held, json.loads(wrapper))
            else:
                if now is not None:
                    hosts.append(now[0])
                    hs.append(now[1])
                    texts.append(json.dumps(held, separators=(",", ":")))
                now, held = (host, bucket), json.loads(wrapper)
            last = h
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hs, pa.int64()), pa.array(texts, pa.string())], names=["host", "h", "wrapper"])
    if now is not None:
        yield pa.record_batch([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([json.dumps(held, separators=(",", ":"))], pa.string())], names=["host", "h", "wrapper"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): JSON of each host's wrapper, from all of its different pages."""
    page = F.col(html_col).cast("string")
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(page).alias("h"), page.alias("html")).where("html is not null")
    many = rows.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    texts = in_batches(rows, _constants, "host string, h long, text long").distinct().groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    often = saved(texts.join(many.hint("merge"), "host").where(2 * F.col("n") >= F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constant")))  # at most two pages' texts
    size = often.agg(F.coalesce(F.sum(F.size("constant") * 8 + 64), F.lit(0))).first()[0]
    one = "host string, h long, wrapper string"
    found = in_batches(rows.join(small(often, 1, size), "host", "left").select("host", "h", "html", "constant"), _skeletons, one)
    found = saved(found)
    buckets = 1 << max(0, (found.count() // BUCKET)).bit_length()
    while True:
        dealt = found.withColumn("bucket", F.pmod("h", F.lit(buckets)))
        dealt = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "h")
        fresh = saved(in_batches(dealt, _wrapped, one))
        released(found)
        found = fresh
        if buckets == 1:
            return found.select("host", "wrapper")
        buckets = max(1, buckets // FAN)


def _planned(batches):
    for batch in batches:
        plans = [json.dumps(plan(json.loads(w)), separators=(",", ":")) for w in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(plans, pa.string())], names=["host", "plan"])


@functools.lru_cache(maxsize=4096)
def _plan_of(text: str) -> dict[str, Any]:
    return json.loads(text)


def _extract(at_html: int, at_plan: int, kept: list[int]):
    def run(batches):
        for batch in batches:
            texts = [main_text(page, _plan_of(p) if p else None) for page, p in zip(batch.column(at_html).to_pylist(), batch.column(at_plan).to_pylist(), strict=True)]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[i] for i in kept), "text"])

    return run


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def extract_main(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, and the main text of every row."""
    plans = saved(in_batches(wrappers(pages, url_col, html_col), _planned, "host string, plan string"))
    size = plans.agg(F.coalesce(F.sum(F.length("plan") + F.length("host")), F.lit(0))).first()[0]
    plans = small(plans.select(F.col("host").alias("__host"), F.col("plan").alias("__plan")), 1, size)
    rows = pages.withColumn(html_col, F.col(html_col).cast("string"))
    joined = rows.join(plans, host_of(F.col(url_col)) == F.col("__host"), "left").drop("__host")
    kept = [i for i, c in enumerate(rows.columns) if c not in (html_col, "text")]
    schema = ", ".join([f"`{rows.columns[i]}` {rows.dtypes[i][1]}" for i in kept] + ["text string"])
    return in_batches(joined, _extract(rows.columns.index(html_col), len(rows.columns), kept), schema)
