r"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is ten consecutive words of an item, or the whole item if it is shorter.
Windows of each text are hashed where they stand and looked up in the set of
window hashes, a table of SLOTS places a window, each 0 or 1 (at most MOST_SLOTS; more windows only mean more false hits), which
travels with the plan. What hits carries
its words and is joined with the windows on hash and words, so a hit is one word by word. That join broadcasts the windows
while they are at most SET_LIMIT and is a shuffle beyond, with the same result.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z is lower-cased; whole texts are read. Null and
empty texts have no words and are clean. Items without words have no windows;
repeated items count once, items with a null id mark words but aren't counted.
Each row of the input gives one row, also with repeated or null ids; other columns
are ignored by find_benchmark and kept by decontaminate, whatever their names; empty tables are allowed on either side. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused, words

WINDOW = 10
SET_LIMIT = 100_000
#: Places of the hash set for each window (and up to the next power of two), and in all (a byte each).
SLOTS, MOST_SLOTS = 8, 1 << 22
#: Rows of a side up to which a join broadcasts it, after counting.
ROW_LIMIT = 200_000
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id string, h, w): each item's distinct windows."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(n))
    cuts = F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size))
    return own.select("item_id", F.explode(cuts).alias("w")).distinct().withColumn("h", F.xxhash64("w"))


def hash_set(windows: DataFrame, n: int) -> bytes:
    """The places of the hashes of n windows as 1 among 0, a power of two of them."""
    size = 1 << 12
    while size < min(MOST_SLOTS, SLOTS * n):
        size *= 2
    there = windows.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("id")).distinct().withColumn("one", F.lit("1"))
    each = windows.sparkSession.range(size).join(there, "id", "left").select("id", F.coalesce("one", F.lit("0")).alias("one"))
    # runs of 4,096 places are put together before they meet
    runs = each.groupBy(F.shiftright("id", 12).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "one"))), lambda x: x["one"]), "").alias("text"))
    whole = runs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.first().text.encode()


def _hits(docs: DataFrame, items: DataFrame, n: int, extra: list[str]) -> DataFrame:
    """A row for each row of docs (extra columns and text): row, the extra columns, n_words, spans (array of
    start and end, sorted) and ids (items with occurring windows)."""
    windows = cut(item_windows(items, n))
    lengths = sorted(r[0] for r in windows.select(F.size("w").alias("k")).distinct().collect())  # n at most
    number = windows.count()
    few = number <= SET_LIMIT
    table = hash_set(windows, number)
    base = docs.select(F.monotonically_increasing_id().alias("row"), *extra, words(F.col("text").cast("string")).alias("ws"))

    def wanted(h):
        return F.substring(F.lit(table), (h.bitwiseAND(F.lit(len(table) - 1)) + 1).cast("int"), F.lit(1)) == F.lit(b"1")

    def candidates(k: int):
        starts = F.when(F.size("ws") >= k, F.sequence(F.lit(1), F.size("ws") - k + 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: wanted(F.xxhash64(F.slice("ws", i, k))))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.slice("ws", i, k).alias("w")))

    none = F.array().cast("array<struct<start:int,w:array<string>>>")
    all_of = F.concat(*[candidates(k) for k in lengths]) if lengths else none
    looked = base.select("row", *extra, F.size("ws").cast("long").alias("n_words"), F.explode_outer(all_of).alias("x"))
    looked = looked.select("row", *extra, "n_words", "x.start", "x.w", F.xxhash64("x.w").alias("h"))
    known = windows.withColumn("found", F.lit(True))
    found = looked.join(F.broadcast(known) if few else known, ["h", "w"], "left")
    span = F.when(F.col("hit"), F.struct("start", (F.col("start") + F.size("w")).alias("end")))
    return found.withColumn("hit", F.coalesce("found", F.lit(False))).groupBy("row", *extra, "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set(F.when(F.col("hit"), F.col("item_id"))).alias("ids"))


def find_benchmark(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans."""
    got = _hits(docs, items.select("item_id", "text"), n, ["doc_id"])
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct((a["covered"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("covered"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["covered"].cast("long"),
    )
    return got.withColumn("n_hit", covered).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, spans: bool = False) -> DataFrame:
    """docs without contaminated rows, or, with spans, all rows with the hit words
    (and what follows each up to the next word) cut out of their texts."""
    i, t = unused(docs, "weft_id", "weft_text")
    keyed = docs.withColumns({i: F.col("doc_id"), t: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    got = _hits(keyed.select(F.col(i).alias("id"), F.col(t).alias("t"), "text"), items.select("item_id", "text"), n, ["id", "t"])
    hit_id, hit_text, where = unused(keyed, "weft_hit_id", "weft_hit_text", "weft_spans")
    got = cut(got.where(F.size("spans") > 0).select(F.col("id").alias(hit_id), F.col("t").alias(hit_text), F.col("spans").alias(where)).dropDuplicates([hit_id, hit_text]))
    side = F.broadcast(got) if got.count() <= ROW_LIMIT else got
    same = F.col(i).eqNullSafe(F.col(hit_id)) & (F.col(t) == F.col(hit_text))
    if not spans:
        return keyed.join(side, same, "left_anti").select(*docs.columns)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"{_WORDS}[\x00-\x2F\x3A-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda p, j: ~F.exists(where, lambda s: (s["start"] <= j) & (j < s["end"])))
    text = F.when(F.col(where).isNotNull(), F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("text"))
    return keyed.join(side, same, "left").select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
