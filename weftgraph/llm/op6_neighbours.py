"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so that Euclidean order is cosine order. They are dealt by a hash of vec_id
over blocks of about DATA_BLOCK, and every query is sent to every block. A block keeps PROJECTIONS sorted
arrays, one for each random direction, built once. For a
query, a window centred on the query's own projection is opened in every array and
widened in steps of WIDEN (virtual rehashing: no second index). A vector collides
once for each window it is in; those with at least THRESHOLD of the projections are
verified by their cosine. Widening stops when the window covers REACH times
the distance of the k-th verified vector, at which a vector that near has collided often enough with a
chance of over nine in ten (its collisions are binomial with chance erf(REACH / sqrt 2)); or when the block is exhausted.
Each block returns its best k for each query (ties by vec_id, cosines anew in double precision), and the best k of these are the result.

How many vectors are verified depends on the data alone: few where neighbours are much nearer than the rest. In vectors without
structure (independent normal ones) the fifth neighbour of 50,000 is at three quarters of the mean distance, and no
hashing can tell it apart by few collisions; the README gives the shares.

Vectors that are null, zero, hold null or non-finite components or differ in length from the majority (of equally frequent
lengths the smallest) take no part. Repeated vec_ids count as separate rows, also beside a query of the same id of
which they are copies: only the query's own id is left out. Null vec_ids take no part. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 96
THRESHOLD = 0.85
REACH = 1.58
#: Share of a block that the first windows cover.
FIRST = 0.3
WIDEN = 1.05
DATA_BLOCK = 16_384
SEED = 7


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    ok = df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return ok.where(fine & F.exists("v", lambda x: x != 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with b on the original doubles."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max()
    return np.array([float(np.dot(x, b)) for x in a]) / (np.sqrt(np.array([float(np.dot(x, x)) for x in a])) * np.sqrt(float(np.dot(b, b))))


class Block:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data, self.u = ids, data, unit(data)
        n, d = data.shape
        self.lines = np.random.Generator(np.random.PCG64(SEED)).normal(size=(d, PROJECTIONS))
        at = (self.u @ self.lines).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)
        half = max(1, int(FIRST * n / 2))
        mid = n // 2
        first = float(np.mean(self.sorted[:, min(n - 1, mid + half)] - self.sorted[:, max(0, mid - half)])) / 2
        spread = float(self.sorted[:, -1].max() - self.sorted[:, 0].min()) + 1e-12
        widths = [max(first, 1e-9)]
        while widths[-1] <= 2 * spread:
            widths.append(widths[-1] * WIDEN)
        self.widths = np.array(widths)
        self.verified = 0

    def nearest(self, qid: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and cosines of the best k that are found."""
        n = len(self.ids)
        q = unit(query[None, :])[0]
        at = q @ self.lines
        least = int(np.ceil(THRESHOLD * PROJECTIONS))
        # the ends of all windows of an array by one search each
        low = [np.searchsorted(s, a - self.widths, "left") for s, a in zip(self.sorted, at, strict=True)]
        high = [np.searchsorted(s, a + self.widths, "right") for s, a in zip(self.sorted, at, strict=True)]
        count = np.zeros(n, np.int64)
        seen = self.ids == qid  # not candidates any more
        found = np.zeros(0, np.int64)
        cos = np.zeros(0)
        for step, width in enumerate(self.widths):
            if step:
                parts = [p for o, a, b in zip(self.order, low, high, strict=True) for p in (o[a[step] : a[step - 1]], o[b[step - 1] : b[step]])]
            else:
                parts = [o[a[0] : b[0]] for o, a, b in zip(self.order, low, high, strict=True)]
            count += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((count >= least) & ~seen)
            if len(new):
                seen[new] = True
                found, cos = np.concatenate((found, new)), np.concatenate((cos, self.u[new] @ q))
            if len(found) >= k:
                kth = np.partition(cos, len(cos) - k)[len(cos) - k]
                if width >= REACH * np.sqrt(max(0.0, 2 - 2 * kth)):
                    break
        self.verified += len(found)
        if not len(found):
            return self.ids[:0], cos
        # every one that rounding could have put behind the k-th
        keep = found if len(found) <= k else found[cos >= np.partition(cos, len(cos) - k)[len(cos) - k] - 1e-9]
        exact = exact_cosine(self.data[keep], query)
        best = np.lexsort((self.ids[keep], -exact))[:k]
        return self.ids[keep][best], exact[best]


def _search(k: int):
    """Of rows sorted by block, vectors before queries: the best k of the block for each query."""

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            where, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks"))
            ids, m = batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (asks[1:] != asks[:-1]), [True]))) if len(where) else [0]
            rows: tuple[list, list, list] = ([], [], [])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if where[a] != at:
                    at, held, block = where[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], m[a:b]))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                for i in range(a, b):
                    near, cos = block.nearest(ids[i], m[i], k)
                    rows[0].append(np.full(len(near), ids[i]))
                    rows[1].append(near)
                    rows[2].append(cos)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], names=["query_id", "vec_id", "score"])

    return run


def nearest(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of each row whose vec_id is
    divisible by every."""
    rows = valid(df)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes.d)
    blocks = -(-sizes["count"] // DATA_BLOCK)
    vectors = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = vectors.unionByName(asked).repartition(int(blocks), "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
