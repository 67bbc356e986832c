"""Structure of graphs: degrees, adjacency, CSR, set operations.

Edges are (src, dst, weight) BIGINT, a bag: repeated edges and loops count. Vertices
are (id) BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Probabilities of the degree report.
PERCENTILES = [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99]


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every vertex."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    ends = ends.union(vertices.select("id", F.lit(0), F.lit(0)))  # one aggregation instead of two outer joins
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def zero_in(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def zero_out(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def describe(df: DataFrame, column: str, probabilities=PERCENTILES) -> DataFrame:
    """One row: count, mean, standard deviation, extremes and exact percentiles."""
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("least"),
        F.max(column).alias("most"),
        *[F.percentile(column, F.lit(p)).alias(f"p{round(p * 100):02d}") for p in probabilities],
    )


def top_degree(edges: DataFrame, vertices: DataFrame, column: str = "out_degree") -> DataFrame:
    """The vertex of largest degree; the smallest id of several."""
    return degrees(edges, vertices).orderBy(F.desc(column), "id").select("id", column).limit(1)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, with its weight."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def positions(edges: DataFrame) -> DataFrame:
    """edges with pos, the place of each in its source's list, from 0."""
    order = Window.partitionBy("src").orderBy("dst", "weight")
    return edges.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): the out-list of each source, sorted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


#: Rows of a slice of prefix_sums.
SLICE = 1 << 20


def prefix_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, before): before is the sum of value over smaller keys. Works by
    ranges of the dense key 0..n-1, of at most SLICE rows: sums of slices are added up in one small window
    (a row for every million), then each slice runs its own, so no task holds all rows."""
    top = df.agg(F.max(key).alias("m")).first().m
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, min(SLICE, -(-((top or 0) + 1) // parts)))
    sliced = df.select(key, value, F.floor(F.col(key) / width).alias("slice"))
    sums = sliced.groupBy("slice").agg(F.sum(value).alias("s"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))  # a row for each slice
    inner = Window.partitionBy("slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(F.broadcast(base), "slice").select(key, value, (F.col("base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("before"))


def csr(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offsets (id, offset) and targets (place, dst, weight) of the compressed rows."""
    out = degrees(edges, vertices).select("id", "out_degree")
    offsets = prefix_sums(out, "id", "out_degree").select("id", F.col("before").alias("offset"))
    placed = positions(edges).join(offsets.withColumnRenamed("id", "src"), "src")
    return offsets, placed.select((F.col("offset") + F.col("pos")).alias("place"), "dst", "weight")


def missing_ids(vertices: DataFrame, n: int) -> DataFrame:
    """Ids from 0 to n - 1 that vertices lacks."""
    return vertices.sparkSession.range(n).join(vertices.select("id"), "id", "left_anti")


def edge_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (as a bag) that only one side has, with side."""
    keys = ["src", "dst", "weight"]
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def root_first(vertices: DataFrame, root: int, n: int) -> DataFrame:
    """(id, position): root, root + 1, ... n - 1, 0, ... root - 1."""
    return vertices.select("id", F.pmod(F.col("id") - root + n, F.lit(n)).cast("long").alias("position"))


def shuffled(vertices: DataFrame, root: int, seed: int = 1) -> DataFrame:
    """(id, position): vertices in a random order that begins with root; the same for a seed."""
    drawn = vertices.select("id", (F.col("id") != root).cast("int").alias("later"), F.xxhash64("id", F.lit(seed)).alias("draw"))
    return ordinal(drawn, ["later", "draw", "id"], "position").select("id", "position")


def first_and_last(vertices: DataFrame, n: int, k: int = 50) -> DataFrame:
    """Sample of sources: the first k and the last k ids, all if there are at most 2 k."""
    return vertices.where((F.col("id") < k) | (F.col("id") >= n - k))


def ordinal(df: DataFrame, order: list[str], name: str = "nth") -> DataFrame:
    """df with the place of each row in a total order, from 0. Rows are sorted by ranges;
    only the sizes of the ranges go through the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("weft_part", F.spark_partition_id()))
    before, sizes = 0, {}
    for r in sorted(ranged.groupBy("weft_part").count().collect()):
        sizes[r.weft_part] = before
        before += r["count"]
    if not sizes:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("weft_part")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("weft_part"))
    within = Window.partitionBy("weft_part").orderBy(*order)
    return ranged.withColumn(name, (base + F.row_number().over(within) - 1).cast("long")).drop("weft_part")
