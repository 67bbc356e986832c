"""Where vertices and their edges are put: replicas, split lists, cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ordinal


def assign_rhizome(edges: DataFrame, size: int, cutoff: int) -> DataFrame:
    """edges with rhizome: of a target's in-edges in order of source, blocks of cutoff go to
    its replicas in turn. The order is total over a target, so a very popular target
    is one window; salt by hash instead where the order does not matter."""
    order = Window.partitionBy("dst").orderBy("src", "weight")
    k = F.row_number().over(order) - 1
    return edges.withColumn("rhizome", F.pmod(F.floor(k / cutoff), F.lit(size)).cast("int"))


def split_lists(edges: DataFrame, capacity: int) -> DataFrame:
    """(id, chunk, dsts): out-lists cut into chunks of capacity edges."""
    order = Window.partitionBy("src").orderBy("dst", "weight")
    cut = edges.withColumn("pos", F.row_number().over(order) - 1).withColumn("chunk", F.floor(F.col("pos") / capacity))
    return cut.groupBy(F.col("src").alias("id"), "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("x")).select("id", "chunk", F.col("x.dst").alias("dsts"))


def tree_shape(degree: int, edges_min: int, edges_max: int, children: int) -> tuple[int, int]:
    """(nodes, depth) of the tree that holds a list of so many edges: a full node hands
    further edges to its children in turn. It moves on to the next child when the edges
    that reached it are a multiple of edges_max, the root also at twice edges_min (and, with
    three children, three times)."""
    nodes = [{"held": 0, "total": 0, "next": 0, "kids": {}, "level": 0}]
    turns = {2 * edges_min, 3 * edges_min} if children == 3 else {2 * edges_min}
    for _ in range(degree):
        at = 0
        while True:
            node = nodes[at]
            node["total"] += 1
            if node["held"] < (edges_min if node["level"] < 2 else edges_max):
                node["held"] += 1
                break
            child = node["kids"].get(node["next"])
            if child is None:
                nodes.append({"held": 0, "total": 0, "next": 0, "kids": {}, "level": node["level"] + 1})
                child = node["kids"][node["next"]] = len(nodes) - 1
            if node["total"] % edges_max == 0 or (node["level"] == 0 and node["total"] in turns):
                node["next"] = (node["next"] + 1) % children
            at = child
    return len(nodes), max(n["level"] for n in nodes)


def rpvo_layout(degrees: DataFrame, edges_min: int, edges_max: int, children: int) -> DataFrame:
    """(id, nodes, depth) of the split list of each vertex (id, out_degree). The shape depends
    on the degree alone: it is worked out once for each different degree."""

    def shapes(batches):
        for pdf in batches:
            found = [tree_shape(int(d), edges_min, edges_max, children) for d in pdf.out_degree]
            yield pdf.assign(nodes=[n for n, _ in found], depth=[d for _, d in found])

    each = degrees.select(F.col("out_degree").cast("long").alias("out_degree")).distinct().mapInPandas(shapes, "out_degree long, nodes long, depth long")
    return degrees.join(each, "out_degree").select("id", "nodes", "depth")


def centre(dim_x: int, dim_y: int) -> int:
    return dim_x * (dim_y // 2) + dim_y // 2


def place_cyclic(vertices: DataFrame, root: int, n: int, dim_x: int, dim_y: int, start: int | None = None) -> DataFrame:
    """(id, cc_id, x, y): vertices, root first, dealt over the cells from start (the centre)."""
    start = centre(dim_x, dim_y) if start is None else start
    position = F.pmod(F.col("id") - root + n, F.lit(n))
    cc = F.pmod(position + start, F.lit(dim_x * dim_y)).cast("long")
    return vertices.select("id", cc.alias("cc_id"), (cc % dim_y).alias("x"), F.floor(cc / dim_y).cast("long").alias("y"))


def place_vicinity(vertices: DataFrame, cell: Column, radius: int, dim_x: int, dim_y: int, seed: int = 1) -> DataFrame:
    """(id, cc_id): a random cell at most radius away (in x and in y) from cell, clipped to
    the grid, never cell itself."""
    x, y = cell % dim_y, F.floor(cell / dim_y)
    span = 2 * radius + 1
    pick = F.floor(F.rand(seed) * (span * span - 1))
    pick = F.when(pick >= span * radius + radius, pick + 1).otherwise(pick)  # leaves the middle out
    nx = F.least(F.greatest(x + pick % span - radius, F.lit(0)), F.lit(dim_y - 1))
    ny = F.least(F.greatest(y + F.floor(pick / span) - radius, F.lit(0)), F.lit(dim_x - 1))
    placed = vertices.withColumn("from", cell).withColumn("to", (ny * dim_y + nx).cast("long"))
    other = F.when(F.col("to") % dim_y < dim_y - 1, F.col("to") + 1).otherwise(F.col("to") - 1)  # clipped onto the cell itself
    return placed.select("id", F.when(F.col("to") == F.col("from"), other).otherwise(F.col("to")).alias("cc_id"))


def stream_chunks(edges: DataFrame, order: list[str], dim_x: int, m: int) -> DataFrame:
    """edges with channel: 2 dim_x equal runs in stream order, the rest to the last."""
    size = max(1, m // (2 * dim_x))
    return ordinal(edges, order).withColumn("channel", F.least(F.floor(F.col("nth") / size), F.lit(2 * dim_x - 1)).cast("int")).drop("nth")


def memory_report(placed: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """(cc_id, used, over): bytes of the vertices (id, bytes) put on each cell."""
    return placed.join(sizes, "id").groupBy("cc_id").agg(F.sum("bytes").alias("used")).withColumn("over", F.col("used") > budget)
