"""URL filters that follow redirects.

Rules decide URLs whose host and path they fit (the longest wins). Canonical links
and refresh redirects in the pages join URLs into components; a URL that no rule
fits takes its component's decision: allow if any URL of the component is allowed
by a rule, else block if any is blocked, else allow. A rule on the URL itself
always wins.

URLs are compared without scheme and fragment, with the host in lower case. Null
URLs, and those without ://, have empty host and path, fit no rule and are
allowed. Targets relative to the page count (of entities only &amp; and &#38; are resolved; <base href> is not read). Each row gives one row, repeated
rows and null ids too; equally long rules go by name; other columns are ignored; null html has no
links, long html is read whole; an empty table gives an empty result. DataFrame operations only.

Hubs: a URL that very many pages link to is the smallest or a joined node of its component, so steps aggregate it
before the shuffle and its join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, lower_ascii

#: Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_Q = "[\"']?"
_CANONICAL = [rf"(?is)<link\b[^>]*\brel={_Q}canonical\b[^>]*\bhref={_Q}([^\"'>\s]+)", rf"(?is)<link\b[^>]*\bhref={_Q}([^\"'>\s]+)[^>]*\brel={_Q}canonical\b"]
_REFRESH = [rf"(?is)<meta\b[^>]*\bhttp-equiv={_Q}refresh\b[^>]*\burl={_Q}([^\"'>\s]+)", rf"(?is)<meta\b[^>]*\burl={_Q}([^\"'>\s]+)[^>]*\bhttp-equiv={_Q}refresh\b"]


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The key under which URLs are joined; null if there is no host."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.md5(F.concat(host(url), F.when(path(url) == "", "/").otherwise(path(url)), query)))


def rule(url: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host(url) == h) | host(url).endswith("." + h)) & path(url).startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _without_dots(path: Column) -> Column:
    """path with its . and .. segments resolved."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    rest = F.aggregate(F.split(F.regexp_replace(path, "^/", ""), "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(rest, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(rest) > 0), "/").otherwise(""))


def resolve(url: Column, target: Column) -> Column:
    """The URL that target names on the page url; null for other schemes and places in the page."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    root = F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url)))
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(path(url).contains("/"), F.regexp_extract(path(url), r"(?s)^(.*/)", 1)).otherwise("/")
    return (
        F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None))
        .when(target.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(root, path(url), target))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(source URL, target URL) of the canonical links and refresh redirects of pages."""
    html, url = F.col("html"), F.col("url")
    target = [F.regexp_extract_all(html, F.lit(x), 1) for x in (*_CANONICAL, *_REFRESH)]
    marked = pages.where(html.rlike(r"(?i)canonical|refresh")).select(url.alias("a"), F.explode(F.array_distinct(F.concat(*target))).alias("t"))
    target = F.replace(F.replace("t", F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    return marked.where("t != ''").select("a", resolve(F.col("a"), target).alias("b")).where("b is not null")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and component (null for URLs without links).
    redirects: more edges, as (a, b) URLs."""
    links = link_edges(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("a", "b"))
    links = cut(links)
    sides = links.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))
    label = cut(connected_components(sides))
    urls = links.select(F.col("a").alias("u")).unionByName(links.select(F.col("b").alias("u"))).select(node(F.col("u")).alias("node"), rule(F.col("u"), rules)[1].alias("v"))
    decided = urls.join(label, "node").groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"), F.max((F.col("v") == "block").cast("int")).alias("blocked"))
    passed = label.join(decided, "component").select("node", "component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("passed"))
    name, verdict = rule(F.col("url"), rules)
    # URLs without a host meet nothing, and are spread instead of meeting each other under one null key
    key = F.coalesce(node(F.col("url")), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    own = pages.select(F.col("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), name.alias("rule"), verdict.alias("own"), key.alias("node"))
    return own.join(passed, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"), "component")
