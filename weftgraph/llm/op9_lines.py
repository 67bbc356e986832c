"""Line dedup by site-relative frequency.

A line is boilerplate on a site if the share of the site's different pages that
contain it exceeds RATIO and at least MIN_PAGES of them do (a share of exactly RATIO stays). Such lines are dropped
from every page of the site. The site is a column, or the host of a URL column where the table has one (site_of).
Pages with equal text count once, so a page copied
many times does not turn its own lines into boilerplate. Lines are compared
without spaces at their ends; blank lines are never dropped. Long texts are read whole.

Rows whose site is null form a site of their own. Null texts have no lines and
stay null; a text that loses all its lines becomes empty, and its row stays.
Repeated rows and rows with null ids stay. An empty table gives an empty result. Other columns pass
through, whatever their names. DataFrame operations only.

Counting runs on 8-byte hashes of lines with partial aggregation, so a hot line or
site reaches a reducer as one row per task. Lines whose hash is frequent are then counted again by
themselves, so no line is dropped for another of the same hash; pages are told apart by 128 bits. The lines that sites
drop are broadcast while they are at most BYTE_LIMIT bytes, counted first, else joined by a shuffle that AQE splits on hot sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, unused

RATIO = 0.1
MIN_PAGES = 5
BYTE_LIMIT = 8 << 20


def site_of(docs: DataFrame, site: str = "source", url: str = "url") -> Column:
    """The host of the URL where docs has such a column and it holds one, else the column site."""
    if url not in docs.columns:
        return F.col(site)
    host = lower_ascii(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    return F.when(host != "", host).otherwise(F.col(site).cast("string") if site in docs.columns else F.lit(None))


def _lines(text: Column) -> Column:
    """The different lines of a text that are not blank."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def boilerplate(docs: DataFrame, site: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, drop): the lines each site drops."""
    where = F.col(site) if isinstance(site, str) else site
    page = [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), F.col("text")).alias("u")]
    pages = docs.where("text is not null").select(where.alias("site"), *page, _lines(F.col("text")).alias("lines"))
    totals = pages.select("site", "t", "u").distinct().groupBy("site").agg(F.count("*").alias("total")).withColumnRenamed("site", "s")
    totals = cut(totals)

    def frequent(each: DataFrame, line: str) -> DataFrame:
        counted = each.distinct().groupBy("site", line).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
        return counted.join(totals, counted["site"].eqNullSafe(F.col("s"))).where(F.col("n") > ratio * F.col("total"))

    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    often = cut(frequent(pages.select("site", "t", "u", F.explode(hashes).alias("h")), "h").groupBy("site").agg(F.collect_set("h").alias("often")).withColumnRenamed("site", "s"))
    some = pages.join(_small(often, F.size("often") * 8), pages["site"].eqNullSafe(F.col("s")))
    lines = some.select("site", "t", "u", F.explode(F.filter("lines", lambda x: F.array_contains("often", F.xxhash64(x)))).alias("line"))
    return frequent(lines, "line").groupBy("site").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def _small(side: DataFrame, size: Column) -> DataFrame:
    """side, marked for a broadcast if it is small."""
    return F.broadcast(side) if (side.agg(F.sum(size + 64)).first()[0] or 0) <= BYTE_LIMIT else side


def _joined(docs: DataFrame, site: str | Column, ratio: float, min_pages: int) -> tuple[DataFrame, str]:
    """docs with the lines that its site drops, and the name of that column."""
    own, s, drop = unused(docs, "weft_site", "weft_drops_of", "weft_drop")
    drops = cut(boilerplate(docs, site, ratio, min_pages)).select(F.col("site").alias(s), F.col("drop").alias(drop))
    side = _small(drops, F.aggregate(drop, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8))
    keyed = docs.withColumn(own, F.col(site) if isinstance(site, str) else site)
    return keyed.join(side, F.col(own).eqNullSafe(F.col(s)), "left"), drop


def _kept(lines: Column, drop: str) -> Column:
    return F.filter(lines, lambda x: ~((F.trim(x) != "") & F.coalesce(F.array_contains(drop, F.trim(x)), F.lit(False))))


def drop_boilerplate(docs: DataFrame, site: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines removed from their texts."""
    joined, drop = _joined(docs, site, ratio, min_pages)
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(_kept(F.split("text", "\n"), drop), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, site: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_md5 (of what is left of the text; null stays null)."""
    lines = F.split("text", "\n")
    joined, drop = _joined(docs, site, ratio, min_pages)
    got = joined.select("doc_id", "text", lines.alias("l"), _kept(lines, drop).alias("k"))
    n = F.coalesce(F.size("l"), F.lit(0)).cast("long")
    return got.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("l") - F.size("k")).cast("long").alias("n_dropped"),
        F.md5(F.array_join("k", "\n").cast("binary")).alias("kept_md5"),
    )
