"""Web pages and cached roadmaps as items: relevance gates, page kinds, repositories and merged sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaplens.functions import text as tx
from gaplens.operators.records import CLOSE_DATE, is_junk, mentions_product, product_tokens

# Words of features, plans and interviews; plans of fetched pages count milestones too.
FEATURE = r"feature|supports?|you can|ability to|includes?|built[- ]in|offline|sync|export|import|dark mode|notification|widget|integration|api|share|backup|encrypt"
PLAN = r"roadmap|coming soon|planned|we('?re| are) working|will (add|launch|introduce|ship)|upcoming|next (version|release)|on our (list|backlog)|in development|beta"
INTERVIEW = r"interview|podcast|keynote|we announced|we promised|told (reporters|users)|in an interview|our vision|long[- ]term|eventually"
PAGE_PLAN = f"{PLAN}|milestone"
#: Of a hit of a web roadmap: characters of its page, sentences, and entries of each list.
HIT = (2500, 40, 8)
NO_OWNERS = ("topics", "search", "orgs", "settings")


def hints(text: Column, words: str) -> Column:
    return text.rlike(rf"(?iU)\b({words})\b")


def classified(title: Column, snippet: Column, page: Column, chars: int | None = None, most: int | None = None, each: int | None = None) -> Column:
    """struct(kind, current, planned, promised) of a search hit: what its sentences say.

    Whole pages and lists by default; a caller may bound the page's characters, the sentences read and each list's length (and a bullet's, with it).
    """
    title, snippet, page = (F.coalesce(c, F.lit("")) for c in (title, snippet, page))
    lowered = F.lower(title)
    first = lambda items, n: F.slice(items, 1, n) if n else items

    def said(blob: Column) -> Column:
        kind = F.when(hints(blob, PLAN) | lowered.contains("roadmap"), "planned").when(hints(blob, INTERVIEW), "interview_signal").when(hints(blob, FEATURE) | lowered.contains("feature"), "current_feature").otherwise("other")
        sents = F.transform(first(tx.sentences(blob, 40, 280), most), lambda s: F.struct(s.alias("s"), hints(s, PLAN).alias("plan")))
        return F.struct(kind.alias("kind"), hints(blob, INTERVIEW).alias("talk"), sents.alias("sents"))

    def found(b: Column) -> Column:
        which = lambda wanted: F.transform(F.filter(b["sents"], wanted), lambda x: x["s"])
        planned, current = which(lambda x: x["plan"]), which(lambda x: ~x["plan"] & hints(x["s"], FEATURE))
        promised = which(lambda x: x["plan"] & (b["talk"] | hints(x["s"], INTERVIEW)))
        return F.struct(b["kind"].alias("kind"), current.alias("current"), planned.alias("planned"), promised.alias("promised"))

    def listed(b: Column) -> Column:
        kind, thin = b["kind"], (F.size(b["current"]) == 0) & (F.size(b["planned"]) == 0) & (snippet != "")
        text = F.concat(title, F.lit(": "), snippet)
        bullet, none = F.array(F.substring(text, 1, 240) if each else text), F.array().cast("array<string>")
        taken = lambda wanted, part: first(tx.unique(F.when(thin & wanted, bullet).when(thin, none).otherwise(b[part])), each)
        return F.struct(
            kind.alias("kind"),
            taken(~kind.isin("planned", "interview_signal"), "current").alias("current"),
            taken(kind == "planned", "planned").alias("planned"),
            taken(kind == "interview_signal", "promised").alias("promised"),
        )

    blob = F.concat_ws("\n", title, snippet, F.substring(page, 1, chars) if chars else page)
    return tx.bound(tx.bound(tx.bound(blob, said), found), listed)


_SECTION = re.compile(r"<(/?)(article|main|section)\b[^>]*>", re.IGNORECASE)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sections(html: pd.Series) -> pd.Series:
    """What the article, main and section elements of each page hold, by where they begin, inner ones as well as outer ones; an open one ends with the page."""

    def cut(page: str | None) -> list[str]:
        found: list[list[int]] = []
        open_: list[tuple[str, int]] = []
        for tag in _SECTION.finditer(page or ""):
            name = tag[2].lower()
            if not tag[1]:
                open_.append((name, len(found)))
                found.append([tag.end(), len(page)])
            elif any(n == name for n, _ in open_):  # it ends the nearest of its name and what was left open within
                while open_:
                    n, at = open_.pop()
                    found[at][1] = tag.start()
                    if n == name:
                        break
        return [page[a:b] for a, b in found]

    return html.map(cut)


def page_source(pages: DataFrame, name: str, package: str = "", repo: str | None = None, domains: tuple[str, ...] = ()) -> DataFrame:
    """(source_url, text, title) of the pages (url, html) that may speak for a product and do: an allowed host, a mention, and sentences that are about it.

    The steps are columns of their own, so none is worked out twice.
    """
    title = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.where(tx.host_allowed(F.col("url"), name, repo, domains)).select("url", title.alias("title"), _bare(F.col("html")).alias("bare"))
    rows = rows.withColumn("texts", _texts(F.col("bare"), sections(F.col("bare"))))
    rows = rows.withColumn("kept", _kept(F.col("texts"), F.col("title"), F.col("url"), name, package))
    rows = rows.withColumn("found", F.when(F.size("kept") > 0, F.col("kept")).otherwise(_fallback(F.col("bare"), F.col("title"), F.col("url"), name, package)))
    return rows.where(F.size("found") > 0).select(F.col("url").alias("source_url"), F.array_join("found", " ").alias("text"), "title")


def _bare(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>", " ")


def _plain(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(part, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))


def _texts(bare: Column, parts: Column) -> Column:
    return F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(bare)), _plain)


def _says(title: Column, url: Column, name: str, package: str):
    return lambda text: mentions_product(F.concat_ws(" ", title, text, url), name, package)


def _kept(texts: Column, title: Column, url: Column, name: str, package: str) -> Column:
    """Sentences that mention the product, of the sections that do."""
    says = _says(title, url, name, package)
    return F.flatten(F.transform(texts, lambda s: F.when((s != "") & says(s), F.filter(tx.sentences(s), says)).otherwise(F.array().cast("array<string>"))))


def _fallback(bare: Column, title: Column, url: Column, name: str, package: str) -> Column:
    """Of the sentences of a page whose title names the product, those with a token or a plan word."""
    says = _says(title, url, name, package)
    named = F.lower(title).contains(name.lower())
    if package:
        named = named | F.lower(F.concat(title, url)).contains(package.lower())
    wanted = lambda s: (hints(s, PAGE_PLAN) | _any_token(s, name, package)) & says(s)
    return F.when(named, F.filter(tx.sentences(_plain(bare)), wanted)).otherwise(F.array().cast("array<string>"))


def relevant_text(html: Column, title: Column, url: Column, name: str, package: str = "") -> Column:
    """What a page says of a product; null if nothing.

    Sentences that mention it, of the article, main and section elements that mention it (of the whole page without such
    elements); failing those, of the sentences of a page whose title names it the ones with a token or a plan word.
    """
    title, bare = F.coalesce(title, F.lit("")), _bare(html)
    kept = lambda b: F.struct(b["bare"].alias("bare"), _kept(b["texts"], title, url, name, package).alias("kept"))
    found = lambda b: F.when(F.size(b["kept"]) > 0, b["kept"]).otherwise(_fallback(b["bare"], title, url, name, package))
    once = tx.bound(tx.bound(F.struct(bare.alias("bare"), _texts(bare, sections(bare)).alias("texts")), kept), found)
    return tx.bound(once, lambda said: F.when(F.size(said) > 0, F.array_join(said, " ")))


def _any_token(text: Column, name: str, package: str) -> Column:
    out = F.lit(False)
    for token in product_tokens(name, package):
        out = out | F.lower(text).contains(token)
    return out


def discovered_repo(urls: Column, name: str) -> Column:
    """owner/name of the repository that a product's hits suggest, from their addresses in order; empty if none.

    The first whose name fits the product; a later one that fits replaces it where that one holds none of the first two tokens.
    """
    tokens = [t for t in re.split(r"\W+", name.lower()) if len(t) >= 3]

    def step(state: Column, url: Column) -> Column:
        owner = F.regexp_extract(url, r"(?i)github\.com/([^/]+)/([^/#?\s]+)", 1)
        repo = F.regexp_extract(url, r"(?i)github\.com/([^/]+)/([^/#?\s]+)", 2)
        blob = F.translate(F.lower(F.concat_ws(" ", owner, repo)), "-_", "  ")
        fits = F.replace(blob, F.lit(" "), F.lit("")).contains(name.lower().replace(" ", ""))
        for t in tokens[:3]:
            fits = fits | blob.contains(t)
        held = F.lit(False)
        for t in tokens[:2]:
            held = held | F.lower(state).contains(t)
        takes = (owner != "") & ~F.lower(owner).isin(*NO_OWNERS) & F.when(state == "", fits | F.lit(not tokens)).otherwise(fits & ~held)
        return F.when(takes, F.concat_ws("/", owner, repo)).otherwise(state)

    return F.aggregate(urls, F.lit(""), step)


def cached_roadmap(cache: DataFrame, key: str, name: str, package: str = "") -> DataFrame:
    """Items of cached roadmaps (planned_items, promised_unshipped, evidence, current_features): relevant ones, the first of equal texts.

    Planned and promised items are open; evidence is closed where it shows a feature; features count as shipped at a constant date.
    """
    nothing, shipped = F.lit(None).cast("string"), F.lit(f"{CLOSE_DATE}T00:00:00Z")

    def lines(column: str, part: int, kind: str, prefix: str, state: str, done: bool = False) -> DataFrame:
        rows = cache.select(key, F.posexplode(column).alias("pos", "t")).where(mentions_product(F.concat_ws(" ", F.lit(""), "t", F.lit("")), name, package))
        rows = rows.where(~is_junk(F.col("t"))) if done else rows
        text = F.substring("t", 1, 800) if done else F.col("t")
        return rows.select(key, F.lit(part).alias("part"), "pos", F.concat(F.lit(prefix), F.col("pos").cast("string")).alias("item_id"), text.alias("text"), F.lit("shipped" if done else "").alias("labels"), F.lit(state).alias("state"), (shipped if done else nothing).alias("closed_at"), F.lit(kind).alias("kind"), F.lit("").alias("url"))

    seen = cache.select(key, F.posexplode("evidence").alias("pos", "e"))
    title, snippet, url = (F.coalesce(F.col(f"e.{c}"), F.lit("")) for c in ("title", "snippet", "url"))
    blob = F.trim(F.concat(title, F.lit(". "), snippet))
    kind = F.coalesce(F.nullif(F.col("e.kind"), F.lit("")), F.lit("other"))
    fits = mentions_product(F.concat_ws(" ", title, blob, url), name, package) & ~tx.junk_host(url)
    evidence = seen.where(fits).select(key, F.lit(2).alias("part"), "pos", F.coalesce(F.nullif(F.col("e.id"), F.lit("")), F.concat(F.lit("cache-ev-"), F.col("pos").cast("string"))).alias("item_id"), F.substring(blob, 1, 800).alias("text"), kind.alias("labels"), F.when(kind == "current_feature", "closed").otherwise("open").alias("state"), nothing.alias("closed_at"), kind.alias("kind"), url.alias("url"))
    rows = lines("planned_items", 0, "planned", "cache-planned-", "open").unionByName(lines("promised_unshipped", 1, "promised", "cache-promised-", "open")).unionByName(evidence).unionByName(lines("current_features", 3, "current_feature", "cache-feature-", "closed", True))
    same = F.md5(F.substring(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "), 1, 200))
    columns = rows.columns
    first = rows.groupBy(key, same.alias("__same")).agg(F.min_by(F.struct(*columns[1:]), F.struct("part", "pos")).alias("r"))
    return first.select(key, "r.*").drop("part", "pos").withColumn("source", F.lit("cache"))


def cache_source(source: Column, items: Column) -> Column:
    """The roadmap source a cache stands for: none without a relevant item, web where it did not say."""
    return F.when(items == 0, "none").otherwise(F.coalesce(F.nullif(F.nullif(source, F.lit("none")), F.lit("")), F.lit("web")))


def external_items(page_items: DataFrame, pasted: DataFrame) -> DataFrame:
    """Items of a user's own roadmap: pages, then pasted lines."""
    pages = page_items.select("item_id", F.col("item_text").alias("text"), "state", F.lit("web_page").alias("kind"))
    return pages.unionByName(pasted.select("item_id", "text", F.lit("open").alias("state"), F.lit("planned").alias("kind")))


def web_roadmap(hits: DataFrame, key: str, name: str, package: str = "", pages: int = 12, most: int = 25) -> DataFrame:
    """A roadmap for each key from its search hits (ord, url, title, body, page): relevant addresses once, the first `pages` of them
    classified by their first HIT characters, sentences and entries, lists of `most` at most."""
    relevant = hits.where(F.trim("url") != "").where(~tx.host_denied(F.col("url"))).where(mentions_product(F.concat_ws(" ", "title", "body", "url"), name, package, strict=True))
    first = relevant.groupBy(key, F.trim("url").alias("__url")).agg(F.min("ord").alias("ord"))  # neither texts nor pages travel to be ranked
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "__url"))
    chosen = first.withColumn("__place", place).where(F.col("__place") <= pages)
    hit = F.struct("ord", F.trim("url").alias("url"), "title", "body", "page").alias("h")
    rows = relevant.withColumn("__url", F.trim("url")).join(chosen, [key, "ord", "__url"])
    rows = rows.select(key, (F.col("__place") - 1).alias("place"), hit).dropDuplicates([key, "place"])
    page = F.coalesce("h.page", F.lit(""))
    rows = rows.where((page == "") | mentions_product(F.concat_ws(" ", "h.title", F.substring(page, 1, 1500), "h.url"), name, package, strict=True))
    rows = rows.withColumn("c", classified(F.col("h.title"), F.col("h.body"), page, *HIT))
    every = lambda part: F.slice(tx.unique(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(f"c.{part}").alias("l")))), lambda x: x["l"]))), 1, most)
    return rows.groupBy(key).agg(F.count("*").alias("sources"), every("current").alias("current"), every("planned").alias("planned"), every("promised").alias("promised"))


def merged_source(before: Column, sources: Column) -> Column:
    """Web evidence makes a code host's roadmap hybrid and none a web one."""
    return F.when(F.coalesce(sources, F.lit(0)) == 0, before).when(before == "github", "hybrid").when(before == "none", "web").otherwise(before)


def resolve(external: int, cached: tuple[str, int] | None, live: int | None, web: int, repo: str | None, refresh: bool = False) -> tuple[str, str]:
    """(source, which items to take) from how many items each way of finding a roadmap gave.

    A user's own roadmap wins; then the cache, unless refreshed, with live issues (None without credentials) before it; then live
    issues; then gated web pages, hybrid where a repository is known; then none.
    """
    if external:
        return "web", "external"
    if cached is not None and not refresh:
        if live and repo:
            return "github", "live"
        return ("none", "none") if not cached[1] else (cached[0] if cached[0] != "none" else "web", "cache")
    if repo and live:
        return "github", "live"
    return ("hybrid" if repo else "web", "web") if web else ("none", "none")
