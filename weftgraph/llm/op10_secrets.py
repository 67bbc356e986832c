"""Secret scans: base patterns, then a character convolutional network.

Three base patterns give spans of kinds assign, access and hex. Every other run of at
least TOKEN characters of [A-Za-z0-9+/_=.-] with a letter and a digit is a candidate;
the network reads it with its context and the spans it accepts are of kind net. Of a candidate
longer than BODY it reads windows of BODY characters, STRIDE apart, and the largest chance counts.

The network (numpy): one-hot characters, one convolution of FILTERS filters of WIDTH
characters, maximum over candidate and over context, logistic output. It is trained
here, from a fixed seed, on LABELLED generated findings, each a token in context
labelled secret or not (random keys of common shapes against identifiers, versions, dates,
paths, card and telephone numbers), and then on these and all findings of all documents together: every base span as a secret, every other run
of the same shape in texts without any base span as harmless, each in all its readings; nothing is sampled. Equal readings of a kind count once.
Each of PASSES steps follows the gradient summed over every finding, by the executors. The two kinds of found findings weigh the same, each as much as FOUND generated
ones at most, so that a large table does not outweigh the kinds of secrets that the base patterns do not know; if one kind is missing,
no contrast can be learned and the generated ones alone count. A held-out part (generated ones, and those of a quarter of the texts) calibrates
the output (Platt) and fixes the threshold: the highest with recall RECALL of true findings; outputs are counted in steps of
1 / FINE for that. Base spans go through the network too; its chance for them is reported, and they stay whatever it is.

Spans are whole matches in code points, end exclusive. Base spans are cut out of a run, and
what remains on either side is a candidate if it is one by itself. Not offered to the network: tokens under TOKEN characters, and
those that have neither a letter and a digit nor both cases mixed. Null is an empty text. Long texts are read whole. Each row gives one row, repeated rows
and null ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # shorter runs are dropped, and a run is one match
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % TOKEN)
#: A letter and a digit, or small letters between capitals more than once.
_MIXED = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z][A-Z]+[a-z]+[A-Z]")
KINDS = ("assign", "access", "hex", "net")
BEFORE, BODY, AFTER = 24, 48, 8
STRIDE = BODY // 4
WIDTH, FILTERS = 5, 24
LABELLED = 3_000
RECALL = 0.95
SEED = 11
#: All found findings of a kind together weigh as much as this many generated ones, and each as one of them at most.
FOUND = 750
#: Passes over all findings, and the slope under which evidence is weak: a few findings do not turn the network, many do.
PASSES, DAMP = 40, 0.01
#: Outputs are counted in steps of 1 / FINE.
FINE = 1_024
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=.-:\"' "
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the context before, the candidate (its two ends if it is long, which no reading() is), the context after."""
    body = text[start:end]
    if len(body) > BODY:
        body = body[: BODY // 2] + body[-BODY // 2 :]
    parts = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + body.ljust(BODY, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    return np.array([0 if c == "\0" else _CODE.get(c, _SIZE - 1) for c in parts], np.int16)


def _findings(n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings: windows and whether each is a secret."""
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, rng.integers(2, 9))
    hexa, b64 = dig + "abcdef", low + up + dig + "+/"
    names = ["key", "credential", "bearer", "auth", "signature", "private", "pwd", "client_id", "access", "passphrase"]
    x, y = [], []
    for i in range(n):
        secret = i % 2
        if secret:
            kind = rng.integers(0, 4)
            body = [lambda: pick(hexa, rng.integers(20, 64)), lambda: pick(b64, rng.integers(20, 64)) + "=" * rng.integers(0, 3), lambda: pick(up + dig, rng.integers(16, 40)), lambda: pick(["sk", "pk", "gh", "xox"], 1) + "_" + pick(low + up + dig, rng.integers(20, 48))][kind]()
            lead = word() + " " + (names[rng.integers(0, len(names))] + [": ", "=", " = ", " "][rng.integers(0, 4)] if rng.random() < 0.7 else "")
        else:
            kind = rng.integers(0, 7)
            body = [
                lambda: "-".join(word() for _ in range(4)) + pick(dig, 2),
                lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 6),
                lambda: "/".join(word() for _ in range(4)) + "/v" + pick(dig, 1),
                lambda: word() + "." + word() + "." + pick(dig, 1) + "." + pick(dig, 2) + "-" + word(),
                lambda: word() + word() + word() + pick(dig, rng.integers(1, 3)),
                lambda: "id-" + pick(dig, 16),
                lambda: "www." + word() + word() + ".example.com/" + word() + pick(dig, 3),
            ][kind]()
            lead = word() + " " + word() + " "
        text = " ".join(word() for _ in range(2)) + " " + lead
        x.append(window(text + body + " " + word(), len(text), len(text) + len(body)))
        y.append(secret)
    return np.stack(x), np.array(y, float)


def _patches(x: np.ndarray) -> np.ndarray:
    """Rows of the filter table that each place of each window uses."""
    n = x.shape[1] - WIDTH + 1
    return np.stack([x[:, j : j + n].astype(np.int64) + j * _SIZE for j in range(WIDTH)], 2)


_EDGE = BEFORE - WIDTH + 1


def _forward(w, p):
    a = w["f"][p[:, :, 0]]  # windows x places x filters
    for j in range(1, WIDTH):
        a += w["f"][p[:, :, j]]
    a += w["b"]
    np.maximum(a, 0, out=a)
    inside = a[:, _EDGE : BEFORE + BODY]
    outside = np.concatenate((a[:, :_EDGE], a[:, BEFORE + BODY :]), 1)
    h = np.concatenate((inside.max(1), inside.mean(1), outside.max(1)), 1)
    return a, h, h @ w["o"] + w["c"]


def _gradient(w, q, t, weight):
    """Gradient of the weighted sum of log losses over the windows with patches q and labels t."""
    a, h, z = _forward(w, q)
    d = (1 / (1 + np.exp(-z)) - t) * weight
    dh = np.outer(d, w["o"])
    da = np.zeros_like(a)
    inside = slice(_EDGE, BEFORE + BODY)
    i = np.arange(len(d))[:, None]
    k = np.arange(FILTERS)[None, :]
    da[i, _EDGE + a[:, inside].argmax(1), k] += dh[:, :FILTERS]
    da[:, inside] += dh[:, None, FILTERS : 2 * FILTERS] / (BEFORE + BODY - _EDGE)
    out = np.r_[0:_EDGE, BEFORE + BODY : a.shape[1]]
    da[i, out[a[:, out].argmax(1)], k] += dh[:, 2 * FILTERS :]
    da *= a > 0
    # each patch uses one row of each of WIDTH parts of the filter table
    codes = np.concatenate((q[:, :, 0], q[:, 1 - WIDTH :, -1] - (WIDTH - 1) * _SIZE), 1)
    cells = codes[:, :, None] * FILTERS + k
    df = [np.bincount(cells[:, j : j + a.shape[1]].ravel(), da.ravel(), _SIZE * FILTERS) for j in range(WIDTH)]
    return {"f": np.concatenate(df).reshape(w["f"].shape), "b": da.sum((0, 1)), "o": h.T @ d, "c": d.sum()}


class _Adam:
    """Adam; slopes far under damp move a weight in proportion to them, those above by the same step."""

    def __init__(self, w, damp=1e-8):
        self.w, self.damp, self.step = dict(w), damp, 0
        self.speed = {k: np.zeros_like(v) for k, v in w.items()}
        self.power = {k: np.zeros_like(v) for k, v in w.items()}

    def follow(self, grad) -> None:
        self.step += 1
        for key, g in grad.items():
            self.speed[key] = 0.9 * self.speed[key] + 0.1 * g
            self.power[key] = 0.999 * self.power[key] + 0.001 * g * g
            self.w[key] = self.w[key] - 0.01 * (self.speed[key] / (1 - 0.9**self.step)) / (np.sqrt(self.power[key] / (1 - 0.999**self.step)) + self.damp)


def _calibrated(w: dict, z: np.ndarray, t: np.ndarray, weight: np.ndarray) -> dict:
    """w with Platt's two parameters and the threshold, from weighted held-out findings."""
    order = np.argsort(z, kind="stable")
    z, t, weight = z[order], t[order], weight[order]
    scale, shift = 1.0, 0.0
    for _ in range(200):
        r = (1 / (1 + np.exp(-(scale * z + shift))) - t) * weight / weight.sum()
        scale, shift = scale - 0.05 * (r * z).sum(), shift - 0.05 * r.sum()
    chance = 1 / (1 + np.exp(-(scale * z + shift)))
    true, false, own = chance[t == 1], chance[t == 0], weight[t == 1]
    missed = np.cumsum(own) - own  # below each
    threshold = float(true[np.searchsorted(missed, (1 - RECALL) * own.sum(), "right") - 1])
    recall = lambda least: float(own[true >= least].sum() / own.sum())
    return w | {"scale": scale, "shift": shift, "threshold": max(0.5, threshold) if recall(0.5) >= RECALL else threshold, "recall": recall(threshold), "false": float(weight[t == 0][false >= threshold].sum() / weight[t == 0].sum())}


def _taken(batches):
    """Every reading of every base span (secret) and, in texts without base spans, of every other run (harmless), and
    whether it is held out, as all of its text is."""

    def of(text):
        base, held = base_spans(text), zlib.crc32(text.encode("utf-8", "surrogatepass")) % 4 == 0
        for s, e in [(s, e) for s, _, e in base] or candidates(text, base):
            for a, b in readings(s, e):
                yield window(text, a, b).astype(np.uint8).tobytes(), int(bool(base)), held

    for batch in batches:
        every = (x for text in batch.column("text").to_pylist() for x in of(text))
        while part := list(islice(every, 4_096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.binary(), pa.int32(), pa.bool_()), strict=True)], names=["w", "secret", "held"])


def findings_of(docs: DataFrame) -> DataFrame:
    """w (codes of a window, a byte each), secret and held of all findings of all texts; equal windows of a kind are one, held out
    if one of them is."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(_taken, "w binary, secret int, held boolean").groupBy("w", "secret").agg(F.max("held").alias("held"))


def _columns(batch):
    x = np.frombuffer(b"".join(batch.column("w").to_pylist()), np.uint8).reshape(-1, BEFORE + BODY + AFTER)
    return x, batch.column("secret").to_numpy().astype(float), batch.column("weight").to_numpy()


def _slopes(sent):
    """One row: the gradient over all findings of the partition."""

    def run(batches):
        total = np.zeros(0)
        for batch in batches:
            x, y, weight = _columns(batch)
            for i in range(0, len(y), 64):  # as many as stay in a core's cache
                g = _gradient(sent.value, _patches(x[i : i + 64]), y[i : i + 64], weight[i : i + 64])
                g = np.concatenate([np.ravel(g[k]) for k in sorted(g)])
                total = total + g if len(total) else g
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return run


def _outputs(sent):
    """How many findings of a kind and weight have an output, in steps of 1 / FINE."""

    def run(batches):
        for batch in batches:
            x, y, weight = _columns(batch)
            z = np.concatenate([_forward(sent.value, _patches(x[i : i + 256]))[2] for i in range(0, len(y), 256)])
            z = np.floor(np.clip(z, -64, 64) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column("secret"), batch.column("weight")], names=["z", "secret", "weight"])

    return run


def train(found: DataFrame | None = None) -> dict:
    """The network, trained on generated findings and then on them and all of found together."""
    model = _train()
    if found is None:
        return model
    spark = found.sparkSession
    found = cut(found)
    n = {r.secret: r.n for r in found.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    each = min(FOUND, n.get(0, 0), n.get(1, 0))
    if not each:
        return model
    x, y, a, _ = _generated()
    made = spark.createDataFrame([(w.astype(np.uint8).tobytes(), int(k), i >= a, 1.0) for i, (w, k) in enumerate(zip(x, y, strict=True))], "w binary, secret int, held boolean, weight double")
    every = made.unionByName(found.withColumn("weight", F.when(F.col("secret") == 1, each / n[1]).otherwise(each / n[0])))
    # parts and their order depend on the findings alone, so that sums do not depend on the machines
    parts = min(1_024, -(-(len(y) + n[0] + n[1]) // 2_048))
    every = cut(every.repartition(parts, "w").sortWithinPartitions("w", "secret", "weight"))
    learned, held = every.where("not held"), every.where("held")
    whole = learned.agg(F.sum("weight")).first()[0]
    net = _Adam({k: model[k] for k in _WEIGHTS}, DAMP)
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(net.w)
        total = np.sum([np.frombuffer(r.g) for r in learned.mapInArrow(_slopes(sent), "g binary").collect()], 0) / whole
        sent.destroy()
        ends = np.cumsum([np.size(net.w[k]) for k in _WEIGHTS])[:-1]
        net.follow({k: g.reshape(np.shape(net.w[k])) for k, g in zip(_WEIGHTS, np.split(total, ends), strict=True)})
    sent = spark.sparkContext.broadcast(net.w)
    rows = held.mapInArrow(_outputs(sent), "z long, secret int, weight double").groupBy("z", "secret", "weight").count().orderBy("z", "secret", "weight").collect()
    sent.destroy()
    return _calibrated(net.w, *(np.array(c, float) for c in zip(*((r.z / FINE, r.secret, r.weight * r["count"]) for r in rows), strict=True)))


_WEIGHTS = ("b", "c", "f", "o")


def _generated() -> tuple[np.ndarray, np.ndarray, int, np.random.Generator]:
    """Generated findings, whether they are secrets, how many of them are learned from, and what generated them."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    return *_findings(LABELLED, rng), LABELLED * 3 // 4, rng


@lru_cache(1)
def _train() -> dict:
    x, y, cutoff, rng = _generated()
    p, t = _patches(x[:cutoff]), y[:cutoff]
    net = _Adam({"f": rng.normal(0, 0.1, (WIDTH * _SIZE, FILTERS)), "b": np.zeros(FILTERS), "o": rng.normal(0, 0.1, 3 * FILTERS), "c": 0.0})
    for _ in range(6):
        for rows in np.array_split(rng.permutation(cutoff), cutoff // 64):
            net.follow(_gradient(net.w, p[rows], t[rows], 1 / len(rows)))
    return _calibrated(net.w, _forward(net.w, _patches(x[cutoff:]))[2], y[cutoff:], np.ones(len(y) - cutoff))


def chances(model: dict, windows: np.ndarray) -> np.ndarray:
    z = np.concatenate([_forward(model, _patches(windows[i : i + 256]))[2] for i in range(0, len(windows), 256)])
    return 1 / (1 + np.exp(-(model["scale"] * z + model["shift"])))


def readings(start: int, end: int) -> list[tuple[int, int]]:
    """What the network reads of a candidate: all of it, or overlapping windows if it is long."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in range(start, end - BODY, STRIDE)] + [(end - BODY, end)]


def largest(model: dict, texts: list[str], found: list[tuple[int, int, int]]) -> np.ndarray:
    """The largest chance of each candidate (text, start, end), from a bounded number of windows at a time."""
    out = np.zeros(len(found))
    every = ((c, a, b) for c, (_, s, e) in enumerate(found) for a, b in readings(s, e))
    while part := list(islice(every, 4_096)):
        np.maximum.at(out, [c for c, _, _ in part], chances(model, np.stack([window(texts[found[c][0]], a, b) for c, a, b in part])))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for a, _, b in [*base, (end, 0, end)]:
            if a >= end:
                a = b = end
            if a - at >= TOKEN:
                own = text[at:a]
                if _MIXED.search(own):
                    out.append((at, a))
            at = max(at, b)
            if at >= end:
                break
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(model):
    def run(batches):
        own = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            open_ = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, base[i])]
            found: dict[int, list[tuple[int, int, int]]] = {}
            if open_:
                p = largest(own, texts, open_)
                for (i, s, e), x in zip(open_, p, strict=True):
                    if x >= own["threshold"]:
                        found.setdefault(i, []).append((s, 3, e))
            known = [(i, s, e) for i, b in enumerate(base) for s, _, e in b]
            chance: list[list[float]] = [[] for _ in texts]
            for (i, _, _), x in zip(known, largest(own, texts, known) if known else (), strict=True):
                chance[i].append(float(x))
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), count(0), count(1), count(2),
                    pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_join(sorted(b + found.get(i, []))) for i, b in enumerate(base)], pa.string()),
                    pa.array(chance, pa.list_(pa.float64())),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "base_chances"],
            )

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and base_chances (the network's chance for each base span, in their
    order) for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(findings_of(docs)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, base_chances array<double>")
