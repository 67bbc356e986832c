"""N-gram Jaccard join: rare-first prefix filtering, one verification per pair.

Every text becomes the set of its distinct five-word shingles (64-bit hashes).
Texts with equal sets form a class, known by a 64-bit fingerprint of the set.
Shingles are ordered rare first by a frequency sketch over the whole corpus (a
fixed-size table of counters: order decides only how well the filter works, any
order gives the same links). A class posts the shingles of its prefix; classes
that share one are candidates if their lengths and the positions of the shared
shingle still allow the threshold.

In a bucket of few classes every pair is a candidate. In a larger one all are
first held against one centre; verified links give components; where classes of a bucket
still differ in component, a second round holds them against CENTRES centres, and a third
tests all pairs that lie in different components, in blocks of BLOCK classes, so no task holds a
bucket whole. In these the suffix filter comes
before the pair is made: the parities of BITS hash ranges differ in no more places
than the sets do, so a pair whose parities differ in too many can not link. Links
inside a component can not change the result: a task does not verify a pair that its links already join, and large
groups of copies cost a few links per member.

Words, shingles and sets are compared by hashes of 64 bits: among 10^9 different words some 0.03 equal pairs are to
be expected by chance, whatever the words look like, and as many among 10^9 different sets.

Empty and null texts have no shingles and link with nothing. Rows with equal
text are one class, also when doc_id repeats or is null (null never becomes a
component id unless no row of the component has an id). An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, cut

SHINGLE = 5
#: A link needs NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
#: Counters in the frequency sketch; it is broadcast, and this bounds it (2 MB).
CELLS = 1 << 20
CHUNKS = 64
#: Tasks that add up the chunks of all tasks; their data are of fixed size, whatever the input.
ADDERS = 16
#: Up to this many classes a bucket yields all its pairs at once.
SMALL = 8
PIECE = 1 << 20
#: Centres of a large bucket in the second round.
CENTRES = 16
#: Parities that a class carries into the second and third round.
BITS = 512
#: Links that one task joins up in memory.
LINKS = 200_000

#: Rows of a side (at most 150 bytes each) up to which a join broadcasts it, after counting.
FEW = 100_000
#: Classes of a bucket that one task holds against each other; larger buckets are cut into blocks.
BLOCK = 1_024

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_STEP = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
#: Words of up to this many bytes are hashed together, eight bytes at a time; longer ones one by one.
SHORT = 32
_KEY = _rng.integers(1, 1 << 63, SHORT // 8 + 1, dtype=np.uint64)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a one-to-one map."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _piece_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of raw. Each eight bytes of a word are mixed under a key of their
    place before they are added up, so words of any structure differ but by chance (2^-64 a pair)."""
    b = np.zeros(len(raw) + 8, np.uint8)
    b[: len(raw)] = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
    out = _BREAK[b[: len(raw)]]
    edge = np.diff(np.concatenate(([True], out, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = last - first
    eight = np.ndarray((len(raw) + 1,), "<u8", b.data, strides=(1,))
    total = size.astype(np.uint64) * _KEY[-1]
    for k in range(SHORT // 8):
        own = np.flatnonzero(size > 8 * k) if k else slice(None)
        at = first[own] + 8 * k
        total[own] += mix((eight[np.minimum(at, len(raw))] & _MASK[np.minimum(size[own] - 8 * k, 8)]) ^ _KEY[k])
    for w in np.flatnonzero(size > SHORT):
        total[w] = xxhash.xxh3_64_intdigest(b[first[w] : last[w]].tobytes())
    return mix(total), first


def texts_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order. Works on pieces of about PIECE bytes."""
    group: list[bytes] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, first = _piece_words(b" ".join(group))
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in group]))
        yield from np.split(hashes, ends[:-1])

    for t in texts:
        if group and held + len(t) > PIECE:
            yield from flush()
            group, held = [], 0
        if len(t) <= PIECE:
            group.append(t)
            held += len(t) + 1
            continue
        parts, at = [], 0
        while at < len(t):
            end = min(len(t), at + PIECE)
            while end < len(t) and not _BREAK[t[end]]:
                end += 1
            parts.append(_piece_words(t[at:end])[0])
            at = end
        yield np.concatenate(parts)
    if group:
        yield from flush()


def shingles(w: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes."""
    if len(w) == 0:
        return w
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += w[j : j + n] * _STEP[j]
    return np.unique(mix(s + _U(k)))


def fingerprint(u: np.ndarray) -> int:
    """64 bits (signed) that stand for a set."""
    with np.errstate(over="ignore"):
        x = mix(np.array([mix(u ^ _U(0xA24BAED4963EE407)).sum(dtype=np.uint64) + _U(len(u))], dtype=np.uint64))
    return int(x.view(np.int64)[0])


def parities(u: np.ndarray) -> np.ndarray:
    """Whether each of BITS hash ranges holds an odd number of a set's shingles, in words of 64 bits."""
    odd = np.bincount((u & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _documents(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield from map(shingles, texts_words([x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column("text").to_pylist()]))


def _chunk_rows(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts = np.split(cells.astype("<u4"), CHUNKS)
    kept = [i for i, x in enumerate(parts) if x.any()]
    return kept, [parts[i].tobytes() for i in kept]


def _total(rows: DataFrame) -> np.ndarray:
    """Adds up tables of CELLS counters; what reaches the driver has that fixed size."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, x in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                part = np.frombuffer(x.as_buffer(), "<u4")
                totals[chunk] = totals.get(chunk, 0) + part.astype(np.int64)
        packed = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    got = rows.repartition(ADDERS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for r in got:
        out[r.chunk * (CELLS // CHUNKS) : (r.chunk + 1) * (CELLS // CHUNKS)] = np.frombuffer(r.counts, "<u4")
    return out


_SURVEY = "doc_id long, n long, f long, odd array<long>, chunk int, counts binary"
_SURVEY_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("odd", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])


def _survey(batches):
    """A row (doc_id, size, fingerprint, parities) for each text, then this task's part of the sketch."""
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        sizes, prints, odd, held, count = [], [], [], [], 0
        for u in _documents(batch):
            sizes.append(len(u))
            prints.append(fingerprint(u))
            odd.append(parities(u))
            held.append(u)
            count += len(u)
            if count > CELLS:
                cells += np.bincount((np.concatenate(held) >> _U(44)).astype(np.int64), minlength=CELLS)
                held, count = [], 0
        if held:
            cells += np.bincount((np.concatenate(held) >> _U(44)).astype(np.int64), minlength=CELLS)
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(odd, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], schema=_SURVEY_ARROW)
    chunk, counts = _chunk_rows(cells)
    none = pa.nulls(len(chunk)).cast(pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(chunk)).cast(pa.list_(pa.int64())), pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())], schema=_SURVEY_ARROW)


def prefix(n):
    """How many of its rarest shingles a set of n has to post."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def index_prefix(n):
    """The same for the smaller set of a pair."""
    return n - (2 * NUM * n + DEN + NUM - 1) // (DEN + NUM) + 1


def need(a, b):
    """The least intersection of sets of a and b that link."""
    return (NUM * (a + b) + DEN + NUM - 1) // (DEN + NUM)


def _postings(rank):
    def post(batches):
        seen: set[int] = set()  # of this task: copies are posted once by each task
        for batch in batches:
            out, rows = [], 0
            for u in _documents(batch):
                n = len(u)
                if n == 0 or (f := fingerprint(u)) in seen:
                    continue
                seen.add(f)
                k = prefix(n)
                u = u[np.argsort(rank.value[(u >> _U(44)).astype(np.int64)], kind="stable")[:k]]
                out.append((u.view(np.int64), np.full(k, f), (n << 31) + np.arange(k)))
                rows += k
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h", "f", "sp"])
                    out, rows = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h", "f", "sp"])

    return post


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """Columns as arrays; a column of lists of one length has two dimensions."""
    got = (batch.column(x) for x in names)
    return [x.flatten().to_numpy().reshape(len(x), -1) if pa.types.is_list(x.type) and len(x) else x.to_numpy(zero_copy_only=False) for x in got]


def _shared(batches):
    """Of postings sorted by (h, f): where more than SMALL classes have the shingle, these classes, once each;
    where 2 to SMALL have it, the candidate pairs among them (h is null, f and sp hold the two)."""
    held: list[np.ndarray] | None = None  # rows of the last shingle that are not sent yet
    sent = 0  # and how many are
    for batch in itertools.chain(batches, (None,)):
        if batch is None:
            if held is None:
                return
            h, f, sp = held
        else:
            h, f, sp = _columns(batch, ("h", "f", "sp"))
            if not len(h):
                continue
            if held is not None:
                h, f, sp = (np.concatenate(x) for x in zip(held, (h, f, sp), strict=True))
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])))
            h, f, sp = h[fresh], f[fresh], sp[fresh]
        start, size = _bounds(h)
        total = size.copy()
        total[0] += sent
        stop = len(h)
        if batch is not None:
            stop = len(h) - 1 if total[-1] > SMALL else int(start[-1])
            held = [x[stop:] for x in (h, f, sp)]
            sent = int(total[-1]) - (len(h) - stop)
        count, first = np.repeat(total, size)[:stop], np.repeat(start, size)[:stop]
        large = count > SMALL
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:stop][large]) for x in (h, f, sp)], names=["h", "f", "sp"])
        row = np.arange(stop)
        for d in range(1, SMALL):  # a bucket of up to SMALL is never cut by a batch
            y = row[~large & (row - d >= first)]
            if (got := _pairs(f, sp, y - d, y)) is not None:
                yield pa.RecordBatch.from_arrays([pa.nulls(got.num_rows).cast(pa.int64()), got.column(0), got.column(1)], names=["h", "f", "sp"])


def fits(sp1: np.ndarray, sp2: np.ndarray) -> np.ndarray:
    """Length and positional filters for classes that share a shingle at these places."""
    a, i, b, j = sp1 >> 31, sp1 & 0x7FFFFFFF, sp2 >> 31, sp2 & 0x7FFFFFFF
    small, at = np.minimum(a, b), np.where(a <= b, i, j)
    at = np.where(a == b, np.minimum(i, j), at)
    return (DEN * small >= NUM * np.maximum(a, b)) & (at < index_prefix(small)) & (1 + np.minimum(a - i, b - j) - 1 >= need(a, b))


def _pairs(f: np.ndarray, sp: np.ndarray, x: np.ndarray, y: np.ndarray, odd: np.ndarray | None = None) -> pa.RecordBatch | None:
    ok = fits(sp[x], sp[y]) & (f[x] != f[y])
    if odd is not None:
        x, y = x[ok], y[ok]
        a, b = sp[x] >> 31, sp[y] >> 31
        ok = np.bitwise_count((odd[x] ^ odd[y]).view(np.uint64)).sum(1, dtype=np.int64) <= a + b - 2 * need(a, b)
    if not ok.any():
        return None
    p, q = f[x[ok]], f[y[ok]]
    both = np.unique(np.stack((np.minimum(p, q), np.maximum(p, q)), 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["f1", "f2"])


def _runs(batches, names: tuple[str, ...]):
    """Columns of whole buckets (equal h, sorted), many buckets at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        c = _columns(batch, names)
        if not len(c[0]):
            continue
        held.append(c)
        h = c[0]
        if h[0] == h[-1] and held[0][0][0] == h[0]:
            continue  # one bucket goes on
        c = [np.concatenate(x) for x in zip(*held, strict=True)]
        cutoff = int(np.searchsorted(c[0], c[0][-1], "left"))
        if cutoff:
            yield [x[:cutoff] for x in c]
        held = [[x[cutoff:] for x in c]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bounds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return start, np.diff(np.concatenate((start, [len(h)])))


def _fitting(batches):
    """Of classes beside a centre (f, sp and g, tp; perhaps odd and godd) the pairs that pass the filters."""
    for batch in batches:
        f, sp, g, tp = _columns(batch, ("f", "sp", "g", "tp"))
        odd = None
        if "odd" in batch.schema.names and len(f):
            odd = np.concatenate(_columns(batch, ("odd", "godd")))
        n = np.arange(len(f))
        if (got := _pairs(np.concatenate((f, g)), np.concatenate((sp, tp)), n, n + len(f), odd)) is not None:
            yield got


def _crossing(batches):
    """In the blocks of a bucket (equal key, sorted by component), the pairs whose classes are in different components
    and, if other says so, in different blocks, and whose parities let them link."""
    for key, c, f, sp, odd, block, other in _runs(batches, ("key", "c", "f", "sp", "odd", "block", "other")):
        for s, n in zip(*_bounds(key), strict=True):
            end = s + n
            if c[s] == c[end - 1]:
                continue
            rows = np.arange(s, end)
            after = s + np.searchsorted(c[s:end], c[s:end], "right")  # first row of a later component
            each = end - after
            for lo in range(0, n, 1 + 500_000 // n):
                part = slice(lo, lo + 1 + 500_000 // n)
                x = np.repeat(rows[part], each[part])
                if not len(x):
                    continue
                y = np.arange(len(x)) - np.repeat(np.cumsum(each[part]) - each[part], each[part]) + np.repeat(after[part], each[part])
                ok = ~other[x] | (block[x] != block[y])
                if (got := _pairs(f, sp, x[ok], y[ok], odd)) is not None:
                    yield got


def _few(side: DataFrame) -> DataFrame:
    """side computed, and broadcast if it has at most FEW rows: then the rows that it joins stay where they are, and
    no bucket meets in one task. Beyond, adaptive execution splits the hot buckets of the join."""
    side = cut(side)
    return F.broadcast(side) if side.count() <= FEW else side


def against_centres(named: DataFrame) -> DataFrame:
    """named (h, c, f, sp, odd) beside up to CENTRES classes of the same bucket in other components: the smallest of
    each share of the bucket. No task holds a bucket: the centres are aggregated, and a hot bucket is split by the join."""
    centre = named.groupBy("h", F.pmod(F.xxhash64("f"), F.lit(CENTRES)).alias("share")).agg(F.min(F.struct("f", "c", "sp", "odd")).alias("z"))
    both = named.join(_few(centre.select("h", "z")), "h").where(F.col("c") != F.col("z.c"))
    return both.select("f", "sp", "odd", F.col("z.f").alias("g"), F.col("z.sp").alias("tp"), F.col("z.odd").alias("godd"))


def in_blocks(named: DataFrame, block: int | None = None) -> DataFrame:
    """named (h, c, f, sp, odd) with a key for each pair of blocks of its bucket that a class belongs to, its block, and
    whether only pairs of different blocks count there."""
    sizes = named.groupBy("h").agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("blocks"))
    own = named.join(_few(sizes), "h").withColumn("block", F.pmod(F.xxhash64("f", F.lit(1)), F.col("blocks")).cast("int"))
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("h", F.least("block", "with"), F.greatest("block", "with"))
    return own.select(key.alias("key"), "c", "f", "sp", "odd", "block", (F.col("block") != F.col("with")).alias("other"))


def _sets(wanted):
    def send(batches):
        seen: set[int] = set()
        for batch in batches:
            prints, sets, held = [], [], 0
            for u in _documents(batch):
                if len(u) == 0 or (f := fingerprint(u)) in seen:
                    continue
                if wanted.value[(f & 0xFFFFFFFFFFFFFFFF) >> 44]:
                    seen.add(f)
                    prints.append(f)
                    sets.append(u.tobytes())
                    held += len(u)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(sets, pa.binary())], names=["f", "u"])
                        prints, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(sets, pa.binary())], names=["f", "u"])

    return send


_GRID = np.arange(1, 64, dtype=np.uint64) << _U(58)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets that link, or -1. Counts by ranges
    of the hashes bound it from above first (the suffix filter)."""
    least = need(len(a), len(b))
    ca = np.diff(np.concatenate(([0], np.searchsorted(a, _GRID), [len(a)])))
    cb = np.diff(np.concatenate(([0], np.searchsorted(b, _GRID), [len(b)])))
    if np.minimum(ca, cb).sum() < least:
        return -1
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both if both >= least else -1


def _verify(batches):
    """Links of this task's pairs, less those whose ends its earlier links already join."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for batch in batches:
        keep = []
        for f1, f2, x, y in zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), batch.column("u1"), batch.column("u2"), strict=True):
            r1, r2 = top(f1), top(f2)
            link = r1 != r2 and overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= 0
            if link:
                root[r1] = r2
            keep.append(link)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("f1").filter(mask), batch.column("f2").filter(mask)], names=["f1", "f2"])


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A bit for each of CELLS ranges of fingerprints: whether a pair has an end in it. Bitmaps are aggregated before the
    shuffle, and 128 KB reach the driver, whatever the number of pairs."""
    ends = pairs.select(F.explode(F.array("f1", "f2")).alias("f")).select(F.shiftrightunsigned("f", 44).alias("cell"))
    bits = ends.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))
    out = np.zeros(CELLS, bool)
    for r in bits.collect():
        part = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links that span the pairs of classes that link. Only sets that a pair may ask for leave the scan:
    a table of CELLS bits says which; false hits cost traffic, never a result."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(pairs))
    sets = docs.mapInArrow(_sets(wanted), "f long, u binary").dropDuplicates(["f"])
    one = pairs.join(sets.select(F.col("f").alias("f1"), F.col("u").alias("u1")), "f1")
    two = one.join(sets.select(F.col("f").alias("f2"), F.col("u").alias("u2")), "f2")
    return two.mapInArrow(_verify, "f1 long, f2 long")


def _stars(batches):
    """Every end of this task's links with the smallest end that they connect it to."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for batch in batches:
        for x, y in zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True):
            a, b = top(x), top(y)
            root[max(a, b)] = min(a, b)
    pairs = [(t, x) for x in list(root) if (t := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["f1", "f2"])


def _components(links: DataFrame) -> DataFrame:
    """Labels of linked classes. Links are first joined up in blocks of about LINKS each,
    so the distributed rounds see a link or two for each class, however dense its group. A single block needs no
    rounds: its stars are the components."""
    blocks = max(1, -(-links.count() // LINKS))
    stars = links.coalesce(blocks).mapInArrow(_stars, "f1 long, f2 long")
    if blocks > 1:
        return cut(connected_components(stars, "f1", "f2"))
    stars = cut(stars)
    return stars.select(F.col("f2").alias("node"), F.col("f1").alias("component")).unionByName(stars.select(F.col("f1").alias("node"), F.col("f1").alias("component")).distinct())


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark)
    survey = scratch.save("survey", docs.mapInArrow(_survey, _SURVEY))
    members = survey.where("n is not null").select("doc_id", "n", "f")
    counts = _total(survey.where("chunk is not null").select("chunk", "counts"))
    rank = spark.sparkContext.broadcast((np.log2(counts.astype(np.float64) + 1) * 2000).astype(np.uint16))

    posted = docs.mapInArrow(_postings(rank), "h long, f long, sp long")
    shared = scratch.save("shared", posted.repartition("h").sortWithinPartitions("h", "f").mapInArrow(_shared, "h long, f long, sp long"))
    large = shared.where("h is not null")
    centre = large.groupBy("h").agg(F.min(F.struct("f", "sp")).alias("z"))
    first = large.join(_few(centre), "h").where("f != z.f").select("f", "sp", F.col("z.f").alias("g"), F.col("z.sp").alias("tp")).mapInArrow(_fitting, "f1 long, f2 long")
    pairs = scratch.save("pairs", shared.where("h is null").select(F.col("f").alias("f1"), F.col("sp").alias("f2")).unionByName(first).distinct())
    links = cut(_linked(docs, pairs))
    labels = _components(links)

    seen = pairs
    for k in range(2):
        label = labels.select(F.col("node").alias("f"), F.col("component").alias("c"))
        named = large.join(label, "f", "left").select("h", F.coalesce("c", "f").alias("c"), "f", "sp")
        mixed = cut(named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h"))
        if not (buckets := mixed.count()):
            break  # all classes of each bucket are joined
        mixed = F.broadcast(mixed) if buckets <= FEW else mixed
        named = scratch.save(f"mixed{k}", named.join(mixed, "h", "left_semi"))
        odd = survey.where("n > 0").select("f", "odd").join(named.select("f").distinct(), "f", "left_semi").groupBy("f").agg(F.first("odd").alias("odd"))
        named = named.join(odd, "f")
        if k == 0:
            rest = against_centres(named).mapInArrow(_fitting, "f1 long, f2 long")
        else:
            rest = in_blocks(named).repartition("key").sortWithinPartitions("key", "c", "f").mapInArrow(_crossing, "f1 long, f2 long")
        rest = cut(rest.distinct().join(seen, ["f1", "f2"], "left_anti"))
        scratch.drop(f"mixed{k}")
        if rest.isEmpty():
            continue
        links = cut(links.unionByName(_linked(docs, rest)))
        labels = _components(links)
        seen = seen.unionByName(rest)
    label = labels.select(F.col("node").alias("f"), F.col("component").alias("c"))
    for name in ("shared", "pairs"):
        scratch.drop(name)

    classes = members.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("d")).join(label, "f", "left").withColumn("c", F.coalesce("c", "f"))
    least = classes.groupBy("c").agg(F.min("d").alias("component_id"))
    named = classes.join(least, "c").select("f", "component_id")
    with_words = members.where("n > 0").join(named, "f").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = cut(with_words.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))
    scratch.drop("survey")
    return out
