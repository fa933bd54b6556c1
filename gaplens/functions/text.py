"""Column expressions over text, dates and hashes; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase families that mark a review as bearing a need.
WANT = (
    r"wish|would love|would like|would be (nice|great|good|better|awesome)|hope|please add|please (fix|make|include)|missing|lack of|lacks?|"
    r"no way to|can't|cant|cannot|doesn't let|should (have|be able|allow|support)|if only|need(s)? (a|an|to|the|more|better)|feature request|"
    r"suggest(ion)?|add(ed|ing)? support|it('?d| would) (be|help)|looking for|miss(ing)? (a|an|the)|faster .+ would|go to at least|at least \d|leads to|would (prefer|appreciate)"
)
PROBLEM = (
    r"bug|broken|crash(es|ed|ing)?|fail(s|ed|ing)?|error|freeze|frozen|stuck|unusable|doesn'?t work|does not work|won'?t work|not work|stopped working|"
    r"keeps? (crashing|failing|stopping)|force.?close|anr|slow network|pause when resuming|never works|always (fails|crashes)|glitch"
)
NEGATED_PROBLEM = r"(without|never|no)\s+(any\s+)?(crash(es|ed|ing)?|fail(s|ed|ing)?|error|bug|glitch|freeze|freezing)"
EXPLICIT = (
    "please add", "please make", "would be nice if", "wish there was", "wish it had", "should have", "should add", "needs a", "need an option",
    "feature request", "add a feature", "hope you add", "please include", "why isn't there", "why is there no", "no option to", "there should be",
)
# Date patterns after ISO, states of finished items, hosts that may carry a change log, hosts never read, hosts of junk.
DATE_FORMATS = ("MMMM d yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMM d, yyyy")
CLOSED_STATES = ("closed", "shipped", "released", "done", "resolved")
KNOWN_HOSTS = (
    "github.com", "gitlab.com", "bitbucket.org", "changelog.com", "keepachangelog.com", "medium.com", "dev.to", "hashnode.dev", "substack.com",
    "wordpress.com", "blogspot.com", "f-droid.org", "play.google.com", "apps.apple.com", "en.wikipedia.org", "reddit.com", "www.reddit.com",
)
DENIED_HOSTS = ("facebook.com", "instagram.com", "tiktok.com", "pinterest.com")
JUNK_HOSTS = ("cleantechnica.com", "cartelinsider.com", "thespinoff.co.nz", "flying-phoenix.dev", "podcasts.apple.com/us/podcast/saas")
# Names that differ from the last part of their package.
DISPLAY_NAMES = {"antennapod": "AntennaPod", "uhabits": "Loop Habit Tracker", "kerneladiutor": "Kernel Adiutor"}
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def normalised(text: Column) -> Column:
    """Lower case, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def need_bearing(text: Column, rating: Column) -> Column:
    """A low rating, a want, or a problem that is not negated; never an empty text. NaN is no low rating."""
    body = F.trim(F.coalesce(text, F.lit("")))
    low = F.coalesce(~F.isnan(rating) & (rating <= 3.0), F.lit(False))
    want = body.rlike(rf"(?iU)\b({WANT})\b")
    problem = F.regexp_replace(body, rf"(?iU)\b{NEGATED_PROBLEM}\b", " ").rlike(rf"(?iU)\b({PROBLEM})\b")
    return (body != "") & (low | want | problem)


def explicit_request(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for marker in EXPLICIT:
        out = out | lowered.contains(marker)
    return F.coalesce(out, F.lit(False))


def parsed_date(text: Column) -> Column:
    """A timestamp (UTC) from ISO or one of DATE_FORMATS; null if none fits: nothing is guessed from other orders of day and month."""
    clean = F.when(~F.lower(F.trim(text)).isin("", "none", "nan", "nat"), F.trim(text))
    iso = F.when(clean.rlike(ISO_DATE), F.try_to_timestamp(F.regexp_replace(clean, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.coalesce(iso, *[F.try_to_timestamp(clean, F.lit(f)) for f in DATE_FORMATS])


def review_id(package: Column, rating: Column, created: Column, text: Column) -> Column:
    """16 hex digits of SHA-1 over package, rating, date and lower-cased text; a null prints as None."""
    printed = [F.coalesce(c.cast("string"), F.lit("None")) for c in (package, rating, created)]
    return F.substring(F.sha1(F.concat_ws("|", *printed, F.lower(F.trim(F.coalesce(text, F.lit("None")))))), 1, 16)


def evidence_id(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(url), 1, 10))


def sentences(text: Column, least: int = 40, most: int = 320) -> Column:
    parts = F.split(text, r"(?<=[.!?])[ \t\n\r\f\x0B]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s).between(least, most))  # F.trim itself would take the place as what to trim


def html_text(html: Column) -> Column:
    """Text of a page without scripts and styles; entities stay encoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))


def url_host(url: Column) -> Column:
    """The host of an address with its port, lower case; empty without a scheme."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def allowed_hosts(product: str, domains: tuple[str, ...] = ()) -> list[str]:
    """KNOWN_HOSTS, the given domains and those that a product's name suggests."""
    slug = "".join(c for c in product.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    guessed = [f"{slug}.org", f"{slug}.com", f"www.{slug}.org", f"www.{slug}.com", f"forum.{slug}.org"] if slug else []
    return [*KNOWN_HOSTS, *(d.lower().lstrip(".") for d in domains), *guessed]


def host_allowed(url: Column, product: str, repo: str | None = None, domains: tuple[str, ...] = ()) -> Column:
    """A host that is allowed with or without www, or lies under an allowed one; a code host needs the repository in the address, if one is known."""
    hosts = allowed_hosts(product, domains)
    host = url_host(url)
    bare = F.regexp_replace(host, r"^www\.", "")
    listed = host.isin(hosts) | bare.isin(hosts)
    under = F.lit(False)
    for h in dict.fromkeys(hosts):
        under = under | host.endswith(f".{h}") | bare.endswith(f".{h}")
    in_repo = F.lower(url).contains(repo.lower()) if repo else F.lit(True)
    return (host != "") & F.when(listed, ~host.endswith("github.com") | in_repo).otherwise(under)


def host_denied(url: Column) -> Column:
    """No host, or one that holds the name of a denied one."""
    host = url_host(url)
    out = host == ""
    for name in DENIED_HOSTS:
        out = out | host.contains(name)
    return out


def junk_host(url: Column) -> Column:
    out = F.lit(False)
    for part in JUNK_HOSTS:
        out = out | F.lower(F.coalesce(url, F.lit(""))).contains(part)
    return out


def display_name(package: Column) -> Column:
    """A name for a package: a known one, else its last part with a capital."""
    tail = F.substring_index(package, ".", -1)
    out = F.when(tail == "", package).otherwise(F.concat(F.upper(F.substring(tail, 1, 1)), F.substring(tail, 2, 1 << 20)))
    for key, name in DISPLAY_NAMES.items():
        out = F.when(F.lower(tail) == key, name).otherwise(out)
    return out


def spaced_name(package: Column) -> Column:
    """The last part of a package cut at capitals and digits, each part with a capital."""
    tail = F.substring_index(package, ".", -1)
    parts = F.regexp_extract_all(tail, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+"), F.lit(0))
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    whole = F.when(tail == "", package).otherwise(capital(tail))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, capital), " ")).otherwise(whole)


def window_label(start: Column, end: Column) -> Column:
    """'Apr 2016', 'Apr–Sep 2016' or 'Dec 2015 – Jan 2016'; null without both dates."""
    month, full = (lambda d: F.date_format(d, "MMM")), (lambda d: F.date_format(d, "MMM yyyy"))
    same_year = F.year(start) == F.year(end)
    label = F.when(same_year & (F.month(start) == F.month(end)), full(start)).when(same_year, F.concat(month(start), F.lit("–"), full(end)))
    return F.when(start.isNotNull() & end.isNotNull(), label.otherwise(F.concat(full(start), F.lit(" – "), full(end))))


def significant(value: Column, figures: int = 3) -> Column:
    """A number rounded to so many significant figures."""
    places = F.lit(figures - 1) - F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), places.cast("double"))
    return F.when(F.isnan(value) | (value == 0), value).otherwise(F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale)


def python_repr(text: Column) -> Column:
    """A string as a Python literal: single quotes, double ones where it has single and no double quotes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(name))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def unique(items: Column) -> Column:
    """Each text of an array once as it stands, the first of those that differ in case and outer space only."""
    plain = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    once = lambda b: F.filter(b["items"], lambda x, i: F.array_position(b["plain"], F.lower(F.trim(x))) == i + 1)
    return bound(bound(items, lambda a: F.struct(a.alias("items"), plain(a).alias("plain"))), once)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often and in whatever lambdas it is named."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its L2 norm; a zero vector stays. A lambda binds vector and norm, else each element would work out both again."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bound = F.transform(F.array(v), lambda a: F.struct(a.alias("v"), norm(a).alias("n")))
    over = lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))
    return F.transform(bound, lambda b: F.transform(b["v"], lambda x: over(x, b["n"])))[0]
