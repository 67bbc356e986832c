"""Toxicity by a weighted finite-state pattern grammar.

A clause ends at one of .!?;: or a line end. A letter trie reads each of its words as a symbol: insult
(any word that begins with a learned stem), threat, target, negation, report, other. Four
transducers are composed into one (transducers.compose): denial turns insults and threats within REACH
words after a negation into denied ones; report turns those after reported speech into
reported ones; aim turns an insult with a target within REACH words on either side into an
aimed one, and a threat into a real one if a target follows, else into nothing (it guesses, and paths whose target does not come end); weigh
puts a learned weight on each reading. The heaviest path of the composed machine reads a clause. A text's
score is the logistic function of a bias and the weights of the readings of its matched clauses, each
counted up to MOST times.

Stems and weights are learned from a bounded sample of labelled rows, at most
SAMPLE_TOXIC and SAMPLE_CLEAN, chosen by a hash of doc_id, texts over SAMPLE_CHARS characters left out; of sampled texts
with the same min-hash (copies) one counts. A stem is the beginning of a word, STEM letters or more, that MIN_DOCS or more
of the sampled toxic texts have, clean ones almost never, and not by chance: the likelihood ratio is CHANCE
or more, and so large that among all terms tried RANDOM one is to be expected by chance. No share of the
toxic texts is asked for, so rare insults are learned as soon as there is evidence. Texts in which the same words stand on both
sides of a stem, as in near copies, are evidence once. Weights are those of a logistic regression with a
normal prior around FALLBACK. Without labels only the fixed word lists apply, with FALLBACK.

Null and empty texts, and texts without a matched clause, score the bias alone. Long texts are read whole. Each row
gives one row, repeated rows and null ids too (null ids are not held out); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .transducers import Transducer, Trie, best, compose

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 20_000
SAMPLE_CHARS = 50_000
STEM = (4, 8)
MIN_DOCS = 4
CHANCE = 24.0
RANDOM = 0.01
NEAR = 3
PURE = 0.9
REACH = 3
THRESHOLD = 0.3
THREAT = "kill hurt destroy beat stab shoot burn töten umbringen schlagen verletzen tuer frapper brûler matar golpear quemar".split()
TARGET = "you your yourself u he she they them him her du dich dir ihr euch sie tu te toi vous il elle tú ti usted ustedes él ella".split()
NEGATION = "not no never isn't aren't don't doesn't nor nicht kein keine nie niemals pas jamais aucun no nunca jamás ningún".split()
REPORT = "said says say told wrote claimed called quoted sagte sagt schrieb meinte dit disait écrit dijo dice escribió".split()
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
READINGS = ("denied", "reported", "insult", "aimed", "threatened")
#: Bias and weights (log odds) without labels, and the centre of what is learned.
FALLBACK = {"bias": -4.0, "denied": 1.0, "reported": 1.5, "insult": 4.0, "aimed": 5.0, "threatened": 3.0}
#: Readings of a kind that count in a text; weight of the prior of the regression.
MOST, PRIOR = 3, 1.0
_CLAUSE = regex.compile(r"[.!?;:\n]")
_WORD = regex.compile(r"[\p{L}\p{M}']+")


def held_out(doc_id: Column, of: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == part, F.lit(False))


TARGETS, NEGATIONS, REPORTS, THREATS = map(frozenset, (TARGET, NEGATION, REPORT, THREAT))


def denial(reach: int = REACH) -> Transducer:
    """States: words left in which a negation still holds."""
    t = Transducer(0, final=set(range(reach + 1)))
    for k in range(reach + 1):
        for x in SYMBOLS:
            held = k > 0 and x in ("insult", "threat")
            t.arc(k, x, "denied" if held else x, 0.0, reach if x == "negation" else max(0, k - 1))
    return t


def report() -> Transducer:
    """States: whether reported speech was announced."""
    t = Transducer(0, final={0, 1})
    for k in (0, 1):
        for x in (*SYMBOLS, "denied"):
            t.arc(k, x, "reported" if k and x in ("insult", "threat") else x, 0.0, 1 if x == "report" else k)
    return t


def aim(reach: int = REACH) -> Transducer:
    """States (t, p): words left in which a target that was read still counts, and words left in which one has to
    come (0: none has to)."""
    t = Transducer((0, 0), final={(k, 0) for k in range(reach + 1)})
    for k in range(reach + 1):
        for p in range(reach + 1):
            on = (max(0, k - 1), p - 1) if p else (max(0, k - 1), 0)
            ends = p == 1  # the last word that could have been the target
            for x in (*SYMBOLS, "denied", "reported"):
                if x == "target":
                    t.arc((k, p), x, x, 0.0, (reach, 0))
                    continue
                if not ends:
                    t.arc((k, p), x, {"insult": "aimed" if k else "insult", "threat": "other"}.get(x, x), 0.0, on)
                if (x == "insult" and not k) or x == "threat":
                    now = "aimed" if x == "insult" else "threatened"
                    if not p:
                        t.arc((k, p), x, now, 0.0, (on[0], reach))
                    elif not ends:
                        t.arc((k, p), x, now, 0.0, on)
    return t


def weigh(weights: dict[str, float]) -> Transducer:
    t = Transducer(0, final={0})
    for x in (*SYMBOLS, *READINGS):
        t.arc(0, x, x, weights.get(x, 0.0), 0)
    return t


class Grammar:
    """The composed machine and the trie; built once in each worker."""

    def __init__(self, stems: list[str], weights: dict[str, float]):
        self.weights = weights
        self.machine = compose(compose(compose(denial(), report()), aim()), weigh(weights))
        named = {w: k for k, own in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in own}
        self.stems, self.sizes = frozenset(stems), sorted({len(s) for s in stems})
        self.trie = Trie(dict.fromkeys(stems, "insult"), named)
        threats = "|".join(sorted(map(regex.escape, THREAT)))
        starts = sorted({regex.escape(s) for s in stems})
        # only clauses that hold one of these can have a reading
        self.trigger = regex.compile(rf"(?<![\p{{L}}\p{{M}}'])(?:{'|'.join([*starts, threats])})")

    def symbols(self, clause: str) -> list[str]:
        return [self.trie.read(w, "other") for w in _WORD.findall(clause)]

    def read_clause(self, clause: str) -> list[str]:
        """The readings on the heaviest path over a clause (lower case)."""
        found = best(self.machine, self.symbols(clause))
        return [x for x in found[1] if x in READINGS] if found else []

    def counts(self, text: str | None) -> tuple[int, ...]:
        """How often a text has each reading, up to MOST."""
        out = dict.fromkeys(READINGS, 0)
        if text:
            low = text.lower()
            at = 0
            while (m := self.trigger.search(low, at)) is not None:
                begin = max((low.rfind(c, 0, m.start()) for c in ".!?;:\n"), default=-1) + 1
                end = stop.start() if (stop := _CLAUSE.search(low, m.end())) else len(low)
                for x in self.read_clause(low[max(begin, at) : end]):
                    out[x] += 1
                at = end
        return tuple(min(MOST, v) for v in out.values())

    def score(self, counts: tuple[int, ...]) -> float:
        z = self.weights["bias"] + sum(self.weights[k] * v for k, v in zip(READINGS, counts, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def regress(rows: list[tuple[tuple[int, ...], int, float]]) -> dict[str, float]:
    """Bias and weights from (counts, toxic, how many) by Newton steps. No weight is under 0: a match is
    never a sign of a clean text."""
    x = np.array([[1, *c] for c, _, _ in rows], float)
    y, n = np.array([t for _, t, _ in rows], float), np.array([k for _, _, k in rows], float)
    centre = np.array([FALLBACK["bias"], *[FALLBACK[k] for k in READINGS]])
    w, keep = centre.copy(), np.array([1e-3, *[PRIOR] * len(READINGS)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (n * (p - y)) + keep * (w - centre)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep), slope)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return {"bias": float(w[0])} | {k: max(0.0, float(v)) for k, v in zip(READINGS, w[1:], strict=True)}


def _terms(batches):
    """Beginnings of words, with how many toxic and clean texts of this task have them."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen = set()
            for w in set(_WORD.findall(text.lower())):
                seen.update(w[:k] for k in range(STEM[0], min(len(w), STEM[1]) + 1))
            (toxic if label else clean).update(seen)
    names = list(toxic)  # what no toxic text has can not become a stem
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], names=["term", "a", "b"])


def least_ratio(terms: int) -> float:
    """The likelihood ratio that, by chance (chi-square, one degree of freedom), RANDOM of so many terms reach."""
    wanted = RANDOM / max(1, terms)
    low, high = 0.0, 1_000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > wanted else (low, mid)
    return max(CHANCE, high)


def _pick(rows) -> list[str]:
    """Short stems first; a longer one is left out if its beginning is in."""
    chosen: set[str] = set()
    for r in sorted(rows, key=lambda r: (len(r.term), -r.a, r.term)):
        if not any(r.term[:k] in chosen for k in range(STEM[0], len(r.term))):
            chosen.add(r.term)
    return sorted(chosen)


def _contexts(terms):
    """(term, before, after): the NEAR words on each side of a term's first place in each toxic text."""

    def run(batches):
        own = terms.value
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if not label:
                    continue
                ws, seen = _WORD.findall(text.lower()), set()
                for i, w in enumerate(ws):
                    for k in range(STEM[0], min(len(w), STEM[1]) + 1):
                        if (t := w[:k]) in own and t not in seen:
                            seen.add(t)
                            rows.append((t, " ".join(ws[max(0, i - NEAR) : i]), " ".join(ws[i + 1 : i + 1 + NEAR])))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], names=["term", "before", "after"])

    return run


def _single(grammar):
    """(stem, toxic) of the texts with exactly one of the stems."""

    def run(batches):
        own = Grammar(*grammar.value)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {w[:k] for w in set(_WORD.findall(text.lower())) for k in own.sizes} & own.stems
                if len(found) == 1:
                    rows.append((found.pop(), toxic))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["stem", "toxic"])

    return run


def _counts(grammar):
    def run(batches):
        own = Grammar(*grammar.value)
        for batch in batches:
            found = [own.counts(t) for t in batch.column("text").to_pylist()]
            made = [pa.array(found, pa.list_(pa.int32())), pa.array([own.score(c) for c in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), *made], names=[*(c for c in batch.schema.names if c != "text"), "readings", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], dict[str, float]]:
    """Stems and weights from docs (doc_id, text) and labels (doc_id, toxic), both of
    training rows only."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1):
        return [], dict(FALLBACK)
    rate = {k: min(1.0, m / counts[k]) for k, m in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) if k in counts}
    chosen = F.lit(False)
    for k, r in rate.items():
        chosen = chosen | ((F.col("toxic") == k) & (place < int(r * (1 << 30))))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(F.broadcast(known.where(chosen)), "doc_id").select("text", "toxic")
    # one text of each group of copies: copies share most of their words, stems are to be shared by different texts
    ws = F.split(F.lower("text"), "\\s+")
    threes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - 3, F.lit(0))), lambda i: F.slice("ws", i + 1, 3))
    different = sample.withColumn("ws", ws).withColumn("copies", F.array(*[F.array_min(F.transform(threes, lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(3)])).drop("ws")
    for k in range(3):
        different = different.withColumn("copy", F.col("copies")[k]).dropDuplicates(["copy", "toxic"]).drop("copy")
    different = cut(different.drop("copies"))
    each = {r.toxic: r["count"] for r in different.groupBy("toxic").count().collect()}
    if not each.get(1):
        return [], dict(FALLBACK)
    terms = different.repartition(8 * spark.sparkContext.defaultParallelism).mapInArrow(_terms, "term string, a long, b long")
    ta, tb = float(each[1]), float(max(1, each.get(0, 0)))
    both = F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (both * ta / (ta + tb))) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * tb / (ta + tb)))).otherwise(0.0))
    totals = cut(terms.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    needed = least_ratio(totals.count())
    evident = (F.col("a") >= MIN_DOCS) & (F.col("b") <= 0.02 * F.col("a")) & (F.col("a") / ta >= PURE * (F.col("a") / ta + F.col("b") / tb)) & (ratio >= needed)
    pure = cut(totals.where(evident))  # of the words of the bounded sample
    names = spark.sparkContext.broadcast(frozenset(r.term for r in pure.select("term").collect()))
    # one side at least differs where texts differ; an insult may stand in a fixed phrase on the other
    apart = different.mapInArrow(_contexts(names), "term string, before string, after string").groupBy("term").agg(F.greatest(F.countDistinct("before"), F.countDistinct("after")).alias("places"))
    stems = _pick(pure.join(apart, "term").withColumn("a", F.least("a", "places")).where(evident).collect())
    # where a stem is the only one of a text, clean texts must not outweigh toxic ones
    alone = different.mapInArrow(_single(spark.sparkContext.broadcast((stems, dict(FALLBACK)))), "stem string, toxic int").groupBy("stem", "toxic").count().collect()
    single = {(r.stem, r.toxic): r["count"] for r in alone}
    stems = [s for s in stems if (a1 := single.get((s, 1), 0) / ta) >= PURE * (a1 + single.get((s, 0), 0) / tb)]
    shared = spark.sparkContext.broadcast((stems, dict(FALLBACK)))
    seen = sample.mapInArrow(_counts(shared), "toxic int, readings array<int>, score double").groupBy("readings", "toxic").count().collect()  # few: MOST and READINGS bound them
    return stems, regress([(tuple(r.readings), r.toxic, r["count"] / rate[r.toxic]) for r in sorted(seen, key=lambda r: (r.readings, r.toxic))])


def score(docs: DataFrame, model: tuple[list[str], dict[str, float]]) -> DataFrame:
    """doc_id, held_out, score, predicted and readings (how often each of READINGS) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    got = own.mapInArrow(_counts(shared), "doc_id long, held_out boolean, readings array<int>, score double")
    return got.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "readings")
