"""Fixpoint queries: levels, distances, PageRank, components, path statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import ordinal, symmetrize, undirected_pairs, vertices_of
from .program import Links, fixed_plans, keys, partitions, vertex_program

#: What stands for "not reached" in results that list all vertices.
UNREACHED = 999_999
#: Distinct pairs up to which a graph is held whole by every task that walks it from many vertices: 8 bytes a pair.
#: All pairs take vertices times edges / 64 steps, so a graph much larger is out of reach for time and not for memory.
PAIRS = 8_000_000
#: Words of 64 sources that a block has at most, and words of a block for all vertices.
WORDS, CELLS = 16, 1 << 21
#: Neighbours that are fetched at once, rows that pull at a time, and neighbours of a row that pulls by itself.
GATHER, TILE, HUB = 1 << 16, 1 << 11, 1 << 12


def _seed(edges: DataFrame, root: int) -> DataFrame:
    return edges.sparkSession.range(root, root + 1).select("id", F.lit(0).cast("long").alias("value"))


def with_all(found: DataFrame, vertices: DataFrame | None, column: str) -> DataFrame:
    """found with a row for every vertex, UNREACHED where it has none."""
    if vertices is None:
        return found
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce(column, F.lit(UNREACHED)).cast("long").alias(column))


def bfs(edges: DataFrame, root: int, max_hops: int | None = None, vertices: DataFrame | None = None, salt: int = 0) -> DataFrame:
    """(id, level): least number of edges from root."""
    links = Links(edges.select("src", "dst"), lambda df: df.distinct())
    try:
        found = vertex_program(links, _seed(edges, root), F.col("value") + 1, max_rounds=max_hops, salt=salt)
    finally:
        links.close()
    return with_all(found.withColumnRenamed("value", "level"), vertices, "level")


def sssp(edges: DataFrame, root: int, max_hops: int | None = None, vertices: DataFrame | None = None, salt: int = 0, on_round=None) -> DataFrame:
    """(id, distance): least sum of weights (not negative) from root, over paths of at
    most max_hops edges if given."""
    light = lambda df: df.groupBy(*[c for c in df.columns if c != "weight"]).agg(F.min("weight").alias("weight"))
    links = Links(edges.select("src", "dst", "weight"), light)
    try:
        found = vertex_program(links, _seed(edges, root), F.col("value") + F.col("weight"), max_rounds=max_hops, salt=salt, on_round=on_round)
    finally:
        links.close()
    return with_all(found.withColumnRenamed("value", "distance"), vertices, "distance")


def deepening(edges: DataFrame, root: int, most: int) -> DataFrame:
    """(depth, reached): vertices within 1, 2, 4, ... most edges of root."""
    depths, d = [], 1
    while d < most:
        depths.append(d)
        d *= 2
    levels = bfs(edges, root, max_hops=most)
    return levels.select(F.explode(F.array(*[F.lit(x) for x in [*depths, most]])).alias("depth"), "level").groupBy("depth").agg(F.sum((F.col("level") <= F.col("depth")).cast("long")).alias("reached"))


def pagerank(
    edges: DataFrame,
    vertices: DataFrame,
    iterations: int = 20,
    damping: float = 0.85,
    init: float | None = None,
    dangling: str = "drop",
    tol: float | None = None,
    salt: int = 0,
    cut_every: int = 3,
) -> DataFrame:
    """(id, score) after that many synchronous iterations from 1 / n (or init). Scores of
    vertices without out-edges are dropped, or with dangling="uniform" shared by all.
    tol: stop when the scores' total change falls under n * tol. salt: sum in two
    phases over so many replicas of a target."""
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("score"))
    spark = edges.sparkSession
    links = Links(edges.select("src", "dst"), lambda df: df.groupBy(*df.columns).agg(F.count("*").alias("many")), out=True)
    sinks = None
    try:
        with fixed_plans(spark):
            ids = keys(vertices.select("id"), "id").repartition(partitions(spark), "id").persist(StorageLevel.MEMORY_AND_DISK)
            if dangling == "uniform":
                sinks = ids.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
            ranks = ids.withColumn("score", F.lit(1.0 / n if init is None else init))
            for k in range(1, iterations + 1):
                sent = links.join(ranks.withColumnRenamed("id", "src")).select(F.col("dst").alias("id"), (F.col("score") / F.col("out") * F.col("many")).alias("share"), "src")
                if salt:
                    sent = sent.groupBy("id", F.pmod(F.xxhash64("src"), F.lit(salt)).alias("replica")).agg(F.sum("share").alias("share"))
                got = sent.groupBy("id").agg(F.sum("share").alias("got"))
                spread = 0.0
                if sinks is not None:
                    spread = (ranks.join(sinks, "id", "left_semi").agg(F.sum("score").alias("s")).first().s or 0.0) / n
                new = ids.join(got, "id", "left").select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + spread)).alias("score"))
                if tol is not None:
                    new = cut(new)
                    change = new.join(ranks.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("c")).first().c
                    ranks = new
                    if change < n * tol:
                        break
                else:
                    ranks = cut(new) if k % cut_every == 0 or k == iterations or sinks is not None else new
            return ranks if iterations else cut(ranks)
    finally:
        links.close()
        ids.unpersist()
        if sinks is not None:
            sinks.unpersist()


def nested_pagerank(edges: DataFrame, vertices: DataFrame, outer: int, inner: int = 10, damping: float = 0.85) -> DataFrame:
    return pagerank(edges, vertices, outer * inner, damping)


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each vertex is connected to, ignoring
    direction. Large-star and small-star steps: O(log^2 n) rounds whatever the
    diameter, where spreading labels would take as many rounds as the diameter. Ends when a
    step changes nothing, which stars are sure to reach."""
    now = cut(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = cut(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return vertices.select("id").join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        seen = state


def component_sizes(found: DataFrame, top: int = 5) -> DataFrame:
    """The largest components: component, size, percent of all vertices."""
    n = found.count()
    return found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(top).withColumn("percent", F.col("size") * 100.0 / n)


def multi_bfs(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(source, id, level) for each source (id): levels from several roots in one loop."""
    links = Links(edges.select("src", "dst"), lambda df: df.distinct())
    frontier = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("level")))
    parts = [frontier]
    try:
        k = 0
        while max_hops is None or k < max_hops:
            k += 1
            sent = links.join(frontier.withColumnRenamed("id", "src")).select("source", F.col("dst").alias("id")).distinct()
            seen = reduce(DataFrame.unionByName, [p.select("source", "id") for p in parts])
            new = cut(sent.join(seen, ["source", "id"], "left_anti").withColumn("level", F.lit(k).cast("long")))
            if new.isEmpty():
                break
            frontier = new
            parts.append(new)
        return cut(reduce(DataFrame.unionByName, parts))
    finally:
        links.close()


def path_lengths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, level) over pairs of different, connected vertices, ignoring direction."""
    return multi_bfs(symmetrize(edges.select("src", "dst")), sources).where("source != id")


def diameter(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(component, diameter) of the components that sources (id, component) covers."""
    found = multi_bfs(symmetrize(edges.select("src", "dst")), sources)
    return found.join(sources.select(F.col("id").alias("source"), "component"), "source").groupBy("component").agg(F.max("level").alias("diameter"))


class Held:
    """A whole graph as arrays, for tasks that walk it from many vertices at once. Edges go both ways.
    Vertices are rows by falling degree, so the k-th neighbours of all vertices that have so many are one slice."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray):
        n = len(ids)
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        order = np.argsort(-degree, kind="stable")
        row = np.empty(n, np.int32)
        row[order] = np.arange(n, dtype=np.int32)
        self.ids, self.degree = ids[order], degree[order]
        src, dst = np.concatenate((row[a], row[b])), np.concatenate((row[b], row[a]))
        self.near = dst[np.argsort(src, kind="stable")]
        self.first = np.concatenate(([0], np.cumsum(self.degree)))

    def pull(self, rows: np.ndarray, wave: np.ndarray) -> np.ndarray:
        """The bits of wave at the neighbours of these rows (rising)."""
        out = np.zeros((len(rows), wave.shape[1]), np.uint64)
        first, degree = self.first[rows], self.degree[rows]
        hubs = int(np.searchsorted(-degree, -HUB))
        for i in range(hubs):
            for at in range(first[i], first[i] + degree[i], GATHER):
                out[i] |= np.bitwise_or.reduce(wave[self.near[at : min(at + GATHER, first[i] + degree[i])]], axis=0)
        for lo in range(hubs, len(rows), TILE):
            part, own, many = out[lo : lo + TILE], first[lo : lo + TILE], -degree[lo : lo + TILE]
            got = np.empty_like(part)
            for k in range(-many[0]):
                m = np.searchsorted(many, -k)
                np.take(wave, self.near[own[:m] + k], axis=0, out=got[:m], mode="clip")
                part[:m] |= got[:m]
        return out

    def push(self, rows: np.ndarray, wave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, bits) that these rows send to their neighbours."""
        degree = self.degree[rows]
        at = np.arange(degree.sum()) + np.repeat(self.first[rows] - np.cumsum(degree) + degree, degree)
        to = self.near[at]
        order = np.argsort(to, kind="stable")
        to = to[order]
        start = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        return to[start], np.bitwise_or.reduceat(wave[np.repeat(rows, degree)[order]], start, axis=0)

    def waves(self, sources: np.ndarray):
        """(level, rows, bits) of the vertices that each level, from 1, adds; bit i of a row of words stands for sources[i]."""
        n, words = len(self.ids), -(-len(sources) // 64)
        wave, seen = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
        i = np.arange(len(sources))
        wave[sources, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
        rows, all_ = np.sort(sources), np.bitwise_or.reduce(wave, axis=0)
        seen |= wave
        open_ = np.arange(n)
        level = 0
        while many := int(self.degree[rows].sum()):
            level += 1
            if 16 * many < self.degree.sum() and many * words < CELLS:
                to, sent = self.push(rows, wave)
            else:
                open_ = open_[(seen[open_] != all_).any(axis=1)]
                to, sent = open_, self.pull(open_, wave)
            sent &= ~seen[to]
            wave[rows] = 0
            some = sent.any(axis=1)
            rows, sent = to[some], sent[some]
            wave[rows] = sent
            seen[rows] |= sent
            if len(rows):
                yield level, rows, sent


def held(edges: DataFrame, pairs: int | None = None) -> Held | None:
    """The graph of the edges, both ways and without loops, or None if it has more than so many distinct pairs (PAIRS)."""
    found = cut(undirected_pairs(edges))
    if found.count() > (PAIRS if pairs is None else pairs):
        return None
    ids = _ids(vertices_of(edges.select("src", "dst")))
    known = edges.sparkSession.sparkContext.broadcast(ids)
    both = [np.frombuffer(r.x, np.int32).reshape(2, -1) for r in _packed(found, "<i4", known)]
    known.destroy()
    a, b = np.concatenate(both, axis=1) if both else np.zeros((2, 0), np.int32)
    return Held(ids, a, b)


def _packed(df: DataFrame, kind: str, known=None) -> list:
    """The columns of df, one after the other, packed by batches; as places in known, if given."""

    def pack(batches):
        for b in batches:
            own = [c.to_numpy() for c in b.columns]
            own = own if known is None else [np.searchsorted(known.value, c) for c in own]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(own).astype(kind).tobytes()], pa.binary())], names=["x"])

    return df.mapInArrow(pack, "x binary").collect()


def _ids(vertices: DataFrame) -> np.ndarray:
    """The distinct ids of vertices (id), rising."""
    own = vertices.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.x, np.int64) for r in _packed(own, "<i8"))]))


def _walked(graph: Held, sources: DataFrame, schema: str, told) -> DataFrame:
    """What told(graph, sources of a block, waves of a block) makes (columns of schema) of each block of sources (id)."""
    spark = sources.sparkSession
    wanted = np.flatnonzero(np.isin(graph.ids, _ids(sources)))
    block = 64 * max(1, min(WORDS, CELLS // max(1, len(graph.ids))))
    blocks = -(-len(wanted) // block)
    given = spark.sparkContext.broadcast((graph, wanted))

    def walk(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                own, sources = given.value
                sources = sources[k * block : (k + 1) * block]
                columns = told(own, sources, own.waves(sources))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

    found = cut(spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(walk, schema))
    given.destroy()
    return found


def _totals(graph: Held, sources: np.ndarray, waves) -> tuple[list, list]:
    found = [(level, int(np.bitwise_count(bits).sum())) for level, _, bits in waves]
    return [x[0] for x in found], [x[1] for x in found]


def _farthest(graph: Held, sources: np.ndarray, waves) -> tuple[np.ndarray, np.ndarray]:
    far = np.zeros(len(sources), np.int64)
    for level, _, bits in waves:
        some = np.bitwise_or.reduce(bits, axis=0)
        far[np.unpackbits(some.view(np.uint8), bitorder="little")[: len(sources)] == 1] = level
    return graph.ids[sources], far


def level_totals(edges: DataFrame, sources: DataFrame, pairs: int | None = None) -> DataFrame:
    """(level, pairs): how many vertices lie at that level, 1 or more, from the sources (id), ignoring direction."""
    graph = held(edges, pairs)
    if graph is None:
        return source_counts(edges, sources).groupBy("level").agg(F.sum("sources").alias("pairs"))
    return _walked(graph, sources, "level long, pairs long", _totals).groupBy("level").agg(F.sum("pairs").alias("pairs"))


def farthest(edges: DataFrame, sources: DataFrame, pairs: int | None = None) -> DataFrame:
    """(id, level): the largest level, ignoring direction, from each of the sources (id), which are whole components."""
    graph = held(edges, pairs)
    if graph is None:
        return source_counts(edges, sources).groupBy("id").agg(F.max("level").alias("level"))
    return _walked(graph, sources, "id long, level long", _farthest)


def source_counts(edges: DataFrame, sources: DataFrame, block: int = 4_096) -> DataFrame:
    """(id, level, sources): how many of the sources (id) lie at that level, 1 or more, from
    the vertex, ignoring direction. A row of a round holds 64 sources as bits of a long,
    so all pairs take n * n / 64 rows; block sources go through one loop."""
    spark = edges.sparkSession
    links = Links(symmetrize(edges.select("src", "dst").where("src != dst")), lambda df: df.distinct())
    placed = cut(ordinal(sources.select("id").distinct(), ["id"], "place"))
    parts: list[DataFrame] = []
    try:
        for begin in range(0, placed.count(), block):
            own = placed.where((F.col("place") >= begin) & (F.col("place") < begin + block))
            bit = F.expr("shiftleft(cast(1 as bigint), cast(place % 64 as int))")
            frontier = seen = cut(own.select("id", F.floor(F.col("place") / 64).alias("word"), bit.alias("bits")))
            level = 0
            while True:
                level += 1
                sent = links.join(frontier.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("bits").alias("sent"))
                old = F.coalesce("bits", F.lit(0).cast("long"))
                both = cut(seen.join(sent, ["id", "word"], "full").select("id", "word", old.alias("old"), F.coalesce("sent", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(old)).alias("new")))
                frontier = both.where("new != 0").select("id", "word", F.col("new").alias("bits"))
                if frontier.isEmpty():
                    break
                seen = both.select("id", "word", F.col("old").bitwiseOR(F.col("new")).alias("bits"))
                parts.append(cut(frontier.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("sources")).select("id", F.lit(level).cast("long").alias("level"), "sources")))
    finally:
        links.close()
    if not parts:
        return spark.createDataFrame([], "id long, level long, sources long")
    return reduce(DataFrame.unionByName, parts).groupBy("id", "level").agg(F.sum("sources").alias("sources"))


def largest_diameters(edges: DataFrame, top: int = 5) -> DataFrame:
    """(component, size, diameter): the exact diameter of each of the largest components."""
    edges = cut(edges.select("src", "dst"))
    found = cut(components(edges, vertices_of(edges)))
    largest = F.broadcast(component_sizes(found, top).select("component", "size"))
    own = cut(found.join(largest, "component").select("id", "component", "size"))
    far = farthest(edges, own)
    return own.join(far, "id", "left").groupBy("component", "size").agg(F.coalesce(F.max("level"), F.lit(0).cast("long")).alias("diameter"))


def average_path(edges: DataFrame) -> DataFrame:
    """(average, pairs) over all ordered pairs of different, connected vertices."""
    edges = cut(edges.select("src", "dst"))
    levels = level_totals(edges, vertices_of(edges))
    return levels.agg((F.sum(F.col("level") * F.col("pairs")) / F.sum("pairs")).alias("average"), F.coalesce(F.sum("pairs"), F.lit(0).cast("long")).alias("pairs"))


def path_distribution(edges: DataFrame, k: int = 50) -> DataFrame:
    """(level, pairs) over pairs of different vertices of the largest component: from all
    its vertices up to 2 k, else from its first and its last k by id."""
    edges = cut(edges.select("src", "dst"))
    found = cut(components(edges, vertices_of(edges)))
    own = ordinal(found.join(F.broadcast(component_sizes(found, 1).select("component")), "component").select("id"), ["id"], "place")
    n = own.count()
    return level_totals(edges, own.where((F.col("place") < k) | (F.col("place") >= n - k)))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, each triangle once. Edges point from lower to higher
    degree, so no list of candidates is longer than the square root of twice the edges."""
    pairs = cut(undirected_pairs(edges))
    deg = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = cut(ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedges = out.join(out.select("x", F.col("y").alias("z")), "x").where("y < z")
    closed = wedges.join(pairs, (F.col("y") == pairs["a"]) & (F.col("z") == pairs["b"]), "left_semi")
    ordered = F.array_sort(F.array("x", "y", "z"))
    return closed.select(ordered[0].alias("a"), ordered[1].alias("b"), ordered[2].alias("c"))


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, triangles, coefficient): 2 t / (d (d - 1)), 0 under two neighbours."""
    pairs = undirected_pairs(edges)
    deg = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    found = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return vertices.select("id").join(deg, "id", "left").join(found, "id", "left").select("id", t.alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("coefficient"))
