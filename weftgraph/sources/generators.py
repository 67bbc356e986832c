"""Random graphs, generated where they will be used: a range of edge numbers and seeded columns.

Equal in distribution to the usual models, not bit by bit to any other generator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.fixpoint import components
from ..operators.graph import symmetrize


def with_weights(edges: DataFrame, seed: int = 1, most: int = 5) -> DataFrame:
    """Weights 1 to most, the same for an edge on every evaluation."""
    return edges.withColumn("weight", (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(most)) + 1).cast("long"))


def _unit(seed: int, *columns: str):
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def _dealt(a: Column, b: Column, bits_a: int, bits_b: int, seed: int) -> tuple[Column, Column]:
    """A keyed one-to-one map of pairs of bits_a and bits_b bits onto themselves (a Feistel network)."""
    for k in range(3):
        a = a.bitwiseXOR(F.xxhash64(b, F.lit(seed + 2 * k)).bitwiseAND(F.lit((1 << bits_a) - 1)))
        b = b.bitwiseXOR(F.xxhash64(a, F.lit(seed + 2 * k + 1)).bitwiseAND(F.lit((1 << bits_b) - 1)))
    return a, b


def erdos_renyi(spark: SparkSession, scale: int, edge_factor: int, directed: bool = True, seed: int = 133) -> DataFrame:
    """Exactly edge_factor * 2^scale distinct edges without loops between 2^scale vertices. Edge number k
    is the k-th pair of a keyed permutation of all pairs, so nothing is drawn twice, sorted or shuffled."""
    n, m = 1 << scale, edge_factor << scale
    pairs = n * (n - 1) // (1 if directed else 2)
    if m > pairs:
        raise ValueError(f"{m} edges asked, {pairs} are possible")
    rows = scale if directed else scale - 1
    low = lambda x: x.bitwiseAND(F.lit(n - 1))
    high = lambda x: F.shiftright(x, scale)
    join = lambda p: F.shiftleft(p[0], scale).bitwiseOR(p[1])
    # a place is (row, column); the last column does not exist: walk on from it until another is reached
    step = lambda x: join(_dealt(high(x), low(x), rows, scale, seed))
    # dealt from the places that exist, cell k at row k / (n - 1)
    start = F.shiftleft(F.floor(F.col("id") / (n - 1)).cast("long"), scale).bitwiseOR((F.col("id") % (n - 1)).cast("long"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(start), lambda x, _: F.when(low(x) == n - 1, step(x)).otherwise(x))
    at = spark.range(m).select(place.alias("p")).select(high(F.col("p")).alias("i"), low(F.col("p")).alias("j"))
    if directed:
        edges = at.select(F.col("i").alias("src"), F.when(F.col("j") >= F.col("i"), F.col("j") + 1).otherwise(F.col("j")).alias("dst"))
        return with_weights(edges, seed)
    own = F.col("j") < n - 1 - F.col("i")  # row i holds the pairs of i and, after them, those of n - 1 - i
    src = F.when(own, F.col("i")).otherwise(n - 1 - F.col("i"))
    dst = F.when(own, F.col("i") + 1 + F.col("j")).otherwise(F.col("j") + 1)
    return symmetrize(with_weights(at.select(src.alias("src"), dst.alias("dst")), seed))


def rmat(spark: SparkSession, scale: int, edge_factor: int, a: float = 0.1, b: float = 0.2, c: float = 0.5, d: float = 0.2, seed: int = 1) -> DataFrame:
    """edge_factor * 2^scale edges; each bit of src and dst by a quadrant with these weights."""
    total = a + b + c + d
    src = dst = F.lit(0).cast("long")
    for k in range(scale):
        u = _unit(seed + k, "id") * total
        src = src * 2 + F.when(u < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((u < a) | ((u >= a + b) & (u < a + b + c)), 0).otherwise(1)
    return with_weights(spark.range(edge_factor << scale).select(src.cast("long").alias("src"), dst.cast("long").alias("dst")), seed)


def preferential(spark: SparkSession, scale: int, edge_factor: int, closing: float = 0.0, seed: int = 1) -> DataFrame:
    """Preferential attachment: a star of edge_factor + 1 vertices, then each vertex links to edge_factor
    different earlier ones, chosen by degree. A link draws an end of a random earlier edge; if that is an
    end which was itself drawn, its draw is worked out again from the same hashes, so every link is a column
    expression of its number and nothing is shuffled. closing: chance that a link goes to a neighbour
    of the previous target (a vertex that it links to) instead, which closes a triangle."""
    n, m = 1 << scale, edge_factor
    if m < 1 or n <= m:
        raise ValueError("more vertices than edge_factor are needed")
    most = 4 * m  # draws of a vertex, of which the first m different ones count

    def ends(v: Column, q: Column, salt: int) -> Column:
        """The target of draw q of vertex v. Edges e < m are the star's (0, e + 1), edge m + (v - m - 1) m + q is draw q of v."""
        pick = lambda v, q, s: F.pmod(F.xxhash64(v, q, F.lit(seed + s)), 2 * m * (v - m))
        first = F.struct(pick(v, q, salt).alias("r"), F.lit(-1).cast("long").alias("v"))

        def follow(x: Column) -> Column:
            e = F.shiftright(x["r"], 1)
            source, q = m + 1 + F.floor((e - m) / m).cast("long"), F.pmod(e - m, F.lit(m)).cast("long")
            end = F.when(e < m, F.when(x["r"] % 2 == 0, F.lit(0).cast("long")).otherwise(e + 1)).when(x["r"] % 2 == 0, source)
            return F.struct(F.when(end.isNull(), pick(source, q, 0)).otherwise(x["r"]).alias("r"), F.coalesce(end, F.lit(-1).cast("long")).alias("v"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda x, _: F.when(x["v"] < 0, follow(x)).otherwise(x))
        return F.greatest(found["v"], F.lit(0))

    each = spark.range(m + 1, n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("q"))
    each = each.select("src", "q", ends(F.col("src"), F.col("q"), 0).alias("dst"))
    if closing:
        old = F.greatest("dst", F.lit(m + 1).cast("long"))
        near = F.when(F.col("dst") > m, ends(old, F.pmod(F.xxhash64("src", "q", F.lit(seed + 7)), F.lit(m)), 0)).otherwise(F.lit(0).cast("long"))
        each = each.select("src", F.explode(F.array(F.struct((2 * F.col("q")).alias("q"), F.col("dst")), F.struct((2 * F.col("q") + 1).alias("q"), F.when(_unit(seed + 3, "src", "q") < closing, near).alias("dst")))).alias("x")).select("src", "x.*").where("dst is not null")
    lists = each.where("src != dst").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "dst"))), lambda x: x["dst"]).alias("d"))  # most draws each
    links = lists.select("src", F.explode(F.slice(F.array_distinct("d"), 1, m)).alias("dst"))
    star = spark.range(1, m + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    return symmetrize(with_weights(star.unionByName(links), seed))


def connected(make: Callable[[int], DataFrame], n: int, seed: int = 1, tries: int = 50) -> DataFrame:
    """make(seed), make(seed + 1), ...: the first graph in which all n vertices are connected."""
    for k in range(tries):
        edges = cut(make(seed + k))
        if components(edges, edges.sparkSession.range(n)).where("component != 0").isEmpty():
            return edges
    raise RuntimeError(f"no connected graph in {tries} tries")


def small_world(spark: SparkSession, scale: int, edge_factor: int, rewire: float = 0.2, seed: int = 1) -> DataFrame:
    """A ring whose vertices link to edge_factor / 2 next ones; each link moves with chance rewire."""
    n = 1 << scale
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, edge_factor // 2)))).alias("j"))
    other = F.floor(_unit(seed + 1, "src", "j") * n)
    dst = F.when(_unit(seed, "src", "j") < rewire, other).otherwise((F.col("src") + F.col("j")) % n)
    pairs = ring.select("src", dst.cast("long").alias("dst")).where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return symmetrize(with_weights(pairs, seed))
