"""Mixing to target weights with soft membership.

A naive Bayes classifier, learned from the labelled table, gives each document its
posterior over domains: toxic (toxic = 1), clean (quality = 1) or rough. Its features are
binned measures of the text and, for each domain, how many of the domain's tell-tale
words occur. A document of n words counts n * posterior tokens for each domain.

Rates r >= 0 of documents are then fitted so that the domain totals sum(r * tokens)
meet the targets, by projected gradient steps on the squared difference, in the metric
of token counts: r = max(0, r + p . y) with y the difference times the inverse of the
domains' Gram matrix. That matrix is of all documents and stays the same, so a
step is of length one over the Lipschitz constant and never makes the fit worse; targets that no
rates meet are approached in least squares. A step needs one aggregation of as many numbers as there are domains; r is
recomputed from the steps, so nothing is collected and nothing is written between.

These steps get short once many rates are 0, so after STEPS of them the fit goes on in proximal
steps (settle_rates): from checkpointed rates r0, the r that minimises the squared difference plus
PROXIMAL / 2 times the squared move is r = max(0, r0 + p . y), and y comes from Newton steps with the Gram
matrix of the documents of rate > 0 and a line search, each one aggregation. It ends when the
projected gradient is under SETTLED, and raises if it does not get there.

Documents without words have no tokens and keep rate 1. Null text has no words. Rows
without labels are mixed like all others; a document as likely in two domains is of the first in DOMAINS; labels with null id or null marks are ignored; without
any labels posteriors are uniform. Repeated rows are documents of their own. An empty
table gives an empty result. DataFrame operations only.

The classifier is learned from a bounded sample: at most SAMPLE labelled documents a
domain, chosen by a hash of doc_id, and of each domain the TELLING words that tell most; class shares come from all labels. Long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, cut, unused

DOMAINS = ("clean", "rough", "toxic")
#: Shares of all tokens.
TARGET = {"clean": 0.80, "rough": 0.15, "toxic": 0.05}
SAMPLE = 2_000
TELLING = 60
BINS = 12
STEPS = 40
TOLERANCE = 1e-9
#: Of settle_rates: tokens that one more plain step would move, as a share of all; weight of the move.
SETTLED = 1e-8
PROXIMAL = 1e-6
ROUNDS = 60
NEWTON = 60
LENGTHS = 24


def measures(text: Column) -> list[Column]:
    """Binned features, each an int from 0 to BINS - 1. Needs the columns n and hit_<domain>."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    share = lambda chars: (size - F.length(F.regexp_replace(t, chars, ""))) / F.greatest(size, F.lit(1))
    scaled = lambda x, k: F.least(F.floor(x * k), F.lit(BINS - 1))
    return [
        F.least(F.floor(F.log2(size + 1) / 1.5), F.lit(BINS - 1)),
        scaled(share("[!?$%&*#@|]+"), 60),
        scaled(share("[A-Z]+"), 20),
        scaled(share("[0-9]+"), 100),
        F.least(F.floor(size / F.greatest(F.col("n"), F.lit(1))), F.lit(BINS - 1)),
    ]


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("rough")


def _hits(telling: dict[str, list[str]]) -> list[Column]:
    return [
        F.least(F.size(F.array_intersect("ws", F.array(*map(F.lit, telling[d])))), F.lit(3)) if telling.get(d) else F.lit(0)
        for d in DOMAINS
    ]


def words(text: Column) -> Column:
    """Array of a text's words in lower case. They only serve as features here, so lower() will do."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _featured(docs: DataFrame, telling: dict[str, list[str]], *keep: str) -> DataFrame:
    base = docs.select(*keep, "text", words(F.col("text")).alias("ws")).withColumn("n", F.size("ws").cast("long"))
    return base.select(*keep, "n", F.array(*[c.cast("int") for c in (*measures(F.col("text")), *_hits(telling))]).alias("x"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier: telling words, log priors, and log likelihoods by domain, feature, bin."""
    known = labels.where("doc_id is not null and toxic in (0, 1) and quality in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).withColumn("domain", domain())
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if not counts:
        return {"telling": {}, "prior": [math.log(1 / len(DOMAINS))] * len(DOMAINS), "table": None}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for d, n in counts.items():
        chosen = chosen | ((F.col("domain") == d) & (place < min(1 << 30, (SAMPLE << 30) // n)))
    sample = cut(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known.where(chosen).select("doc_id", "domain")), "doc_id").select("domain", "text"))
    each = sample.select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).where(F.length("w") >= 3)
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    seen = each.groupBy("w").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS])
    telling = {}
    for d in DOMAINS:
        if not sizes.get(d):
            continue
        own = F.col(d) / sizes[d]
        other = sum((F.col(e) for e in DOMAINS if e != d), F.lit(0)) / max(1, sum(sizes.get(e, 0) for e in DOMAINS if e != d))
        weight = own * F.log((own + 1e-3) / (other + 1e-3))
        best = seen.where((F.col(d) >= 4) & (own > 4 * other)).orderBy(F.desc(weight), "w").limit(TELLING).select("w").collect()
        telling[d] = sorted(r.w for r in best)
    rows = _featured(sample, telling, "domain").select("domain", F.posexplode("x").alias("k", "v")).groupBy("domain", "k", "v").count().collect()
    k = 5 + len(DOMAINS)
    table = np.full((len(DOMAINS), k, BINS), 1.0)
    for r in rows:
        table[DOMAINS.index(r.domain), r.k, r.v] += r["count"]
    total = sum(counts.values())
    return {"telling": telling, "prior": [math.log((counts.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS], "table": np.log(table / table.sum(2, keepdims=True))}


def memberships(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """keep, n_tokens and the posteriors p_<domain>."""
    rows = _featured(docs, model["telling"], *keep)
    logs = []
    for d in range(len(DOMAINS)):
        z = F.lit(float(model["prior"][d]))
        if model["table"] is not None:
            for k in range(model["table"].shape[1]):
                z = z + F.element_at(F.array(*[F.lit(float(x)) for x in model["table"][d, k]]), F.element_at("x", k + 1) + 1)
        logs.append(z.alias(f"z{d}"))
    rows = rows.select(*keep, F.col("n").alias("n_tokens"), *logs)
    top = F.greatest(*[f"z{d}" for d in range(len(DOMAINS))])
    rows = rows.select(*keep, "n_tokens", *[F.exp(F.col(f"z{d}") - top).alias(f"e{d}") for d in range(len(DOMAINS))])
    total = sum((F.col(f"e{d}") for d in range(len(DOMAINS))), F.lit(0.0))
    return rows.select(*keep, "n_tokens", *[(F.col(f"e{d}") / total).alias(f"p_{name}") for d, name in enumerate(DOMAINS)])


def _rate(steps: list[np.ndarray]) -> Column:
    """r after these steps; a chain of maxima over the posteriors."""
    if not steps:
        return F.lit(1.0)
    y = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    move = lambda s: sum((s[d] * F.col(f"p_{name}") for d, name in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(y, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r + move(s)))


def fit_rates(soft: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """soft (from memberships, materialised) with the column rate."""
    target = target or TARGET
    n = F.col("n_tokens").cast("double")
    p = [F.col(f"p_{d}") for d in DOMAINS]
    size = len(DOMAINS)
    steps: list[np.ndarray] = []
    goal = None
    for _ in range(STEPS):
        r = F.when(n > 0, _rate(steps)).otherwise(1.0)
        live = soft.select("n_tokens", *p, r.alias("r"))
        sums = [F.sum(F.col("r") * n * a) for a in p]
        if goal is None:
            sums += [F.sum(n * p[i] * p[j]) for i in range(size) for j in range(size)] + [F.sum(n)]
        got = [float(x or 0) for x in live.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        have = np.array(got[:size])
        if goal is None:
            gram, total = np.array(got[size:-1]).reshape(size, size), got[-1]
            goal = np.array([target[d] for d in DOMAINS]) * total
        gap = goal - have
        if total == 0 or np.abs(gap).max() <= TOLERANCE * total:
            break
        steps.append(np.linalg.lstsq(gram + 1e-9 * total * np.eye(size), gap, rcond=None)[0])
    return soft.withColumn("rate", F.when(n > 0, _rate(steps)).otherwise(1.0))


def settle_rates(soft: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """soft (with n_tokens, p_<domain> and a first rate) with the rate at which the squared
    difference to the targets is least."""
    target = target or TARGET
    size = len(DOMAINS)
    columns = soft.columns
    n, p = F.col("n_tokens").cast("double"), [F.col(f"p_{d}") for d in DOMAINS]
    dot = lambda y: sum((float(y[i]) * p[i] for i in range(size)), F.lit(0.0))
    moved = lambda y: F.greatest(F.lit(0.0), F.col("rate") + dot(y))

    def totals(found: DataFrame, sums: list[Column]) -> np.ndarray:
        return np.array([float(x or 0) for x in found.where(n > 0).agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)]).first()])

    found = cut(soft)
    first = totals(found, [n * p[i] * p[j] for i in range(size) for j in range(size)] + [n])
    gram, total = first[:-1].reshape(size, size), first[-1]
    if total == 0:
        return found
    values, vectors = np.linalg.eigh(gram / total)
    live = values > 1e-9 * values.max()  # directions in which no document has tokens can not be met
    span, inverse = vectors[:, live], vectors[:, live] / values[live] @ vectors[:, live].T
    flat = span @ span.T
    goal = flat @ np.array([target[d] for d in DOMAINS])
    scaled = flat @ (gram / total) @ flat
    for _ in range(ROUNDS):
        have = totals(found, [F.col("rate") * n * a for a in p]) / total
        step = inverse @ (goal - have)
        if totals(found, [n * F.abs(moved(step) - F.col("rate"))])[0] <= SETTLED * total:
            return found
        # least of sum(n r(y)^2) / 2 - goal . y + PROXIMAL y . gram . y / 2, convex in y; each call judges several y at once
        y = np.zeros(size)
        for _ in range(NEWTON):
            r = moved(y)
            on = F.when(r > 0, n).otherwise(0.0)
            got = totals(found, [r * n * a for a in p] + [on * p[i] * p[j] for i in range(size) for j in range(size)]) / total
            slope = flat @ (got[:size] - goal) + PROXIMAL * scaled @ y
            if np.sqrt(max(0.0, slope @ inverse @ slope)) <= 1e-3 * SETTLED:
                break
            bend = span.T @ (got[size:].reshape(size, size) + PROXIMAL * scaled) @ span
            way = -span @ np.linalg.solve(bend, span.T @ slope)
            lengths = [2.0**-k for k in range(LENGTHS)]
            ahead = [y + a * way for a in lengths]
            own = totals(found, [n * sum((float(way[i]) * p[i] for i in range(size)), F.lit(0.0)) * moved(x) for x in ahead]) / total
            rise = [v - goal @ way + PROXIMAL * (scaled @ x) @ way for v, x in zip(own, ahead, strict=True)]
            # the slope along the way grows with the length: the longest one at which it has not turned, or the one with the least slope
            k = next((i for i, v in enumerate(rise) if v <= 0), LENGTHS - 1)
            if k and abs(rise[k - 1]) < abs(rise[k]):
                k -= 1
            if np.abs(ahead[k] - y).max() <= 1e-14 * max(1.0, np.abs(y).max()):
                break
            y = ahead[k]
        found = cut(found.withColumn("rate", F.when(n > 0, moved(y)).otherwise(F.col("rate"))).select(*columns))
    raise RuntimeError(f"rates did not settle in {ROUNDS} rounds")


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, domain (the likeliest) and rate for each row of docs."""
    soft = cut(memberships(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels), "doc_id"))
    return settle_rates(fit_rates(soft, target), target).withColumn("domain", _likeliest())


def mix_rows(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """docs with n_tokens, p_<domain>, domain, rate and copies: how many times the row is to be taken, the whole part of the
    rate, and one more with a chance of the rest, drawn by a hash of id and text. Columns of these names in docs are replaced. Rows whose ids repeat or are
    null are mixed as rows of their own."""
    made = ["n_tokens", *[f"p_{d}" for d in DOMAINS], "domain", "rate", "copies"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in made])
    scratch = None
    [key] = unused(docs, "weft_row")
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:  # written down, so that a row keeps its key
        scratch = Scratch(docs.sparkSession)
        keyed = scratch.save("rows", docs.withColumn(key, F.monotonically_increasing_id()))
    found = mix(keyed.select(F.col(key).alias("doc_id"), "text"), labels, target) if scratch is None else _mixed_rows(keyed, key, labels, target)
    own = found.select(F.col("doc_id").alias(key), *made[:-1])
    rest = F.col("rate") - F.floor("rate")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    joined = keyed.join(own, key).select(*docs.columns, *made[:-1], (F.floor("rate") + (draw < rest).cast("long")).cast("long").alias("copies"))
    if scratch is not None:
        joined = cut(joined)
        scratch.drop("rows")
    return joined


def _mixed_rows(keyed: DataFrame, key: str, labels: DataFrame, target: dict[str, float] | None) -> DataFrame:
    """mix() by row keys; the classifier learns by doc_id."""
    soft = cut(memberships(keyed.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), fit(keyed.select("doc_id", "text"), labels), "doc_id"))
    return settle_rates(fit_rates(soft, target), target).withColumn("domain", _likeliest())


def _likeliest() -> Column:
    return F.coalesce(*[F.when(F.col(f"p_{d}") >= F.greatest(*[f"p_{e}" for e in DOMAINS]), d) for d in DOMAINS])
