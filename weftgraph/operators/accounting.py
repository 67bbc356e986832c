"""What a computation sends: messages, pruned work, hops.

Counts are those of the synchronous rounds (a round sends along all out-edges of
its frontier); asynchronous counts depend on timing and are not reproduced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import INSTRUCTION, hops


def message_stats(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """By round (from 1) of a breadth-first search with these levels (id, level): messages
    created, performed (they set a level first: one each new vertex), false on predicate (the others),
    and diffusions created, which are the newly set vertices."""
    a, b = levels.withColumnsRenamed({"id": "src", "level": "ls"}), levels.withColumnsRenamed({"id": "dst", "level": "ld"})
    sent = edges.select("src", "dst").join(a, "src").groupBy((F.col("ls") + 1).alias("round")).agg(F.count("*").alias("created"))
    new = b.where("ld > 0").groupBy(F.col("ld").alias("round")).agg(F.count("*").alias("performed"))
    j = sent.join(new, "round", "left")
    done = F.coalesce("performed", F.lit(0))
    return j.select("round", "created", done.alias("performed"), (F.col("created") - done).alias("false_on_predicate"), done.alias("diffusions"))


def diffusion_stats(edges: DataFrame, root: int) -> DataFrame:
    """By round (from 1) of a shortest-path search: diffusions created (vertices whose distance fell),
    and how many of them superseded an earlier diffusion of the same vertex, which is thereby pruned."""
    seen: list[DataFrame] = []
    from .fixpoint import sssp

    sssp(edges, root, on_round=lambda k, before, better: seen.append(better.select("id", F.lit(k).cast("long").alias("round"))))
    each = reduce(DataFrame.unionByName, seen)
    first = each.groupBy("id").agg(F.min("round").alias("first"))
    late = F.when(F.col("id") == root, True).otherwise(F.col("round") > F.col("first"))
    return each.join(first, "id").groupBy("round").agg(F.count("*").alias("created"), F.sum(late.cast("long")).alias("pruned"))


def hop_total(edges: DataFrame, placed: DataFrame, dim_x: int, dim_y: int, network: str) -> DataFrame:
    """One row: messages along all edges and the network steps they take."""
    a = placed.select(F.col("id").alias("src"), F.col("cc_id").alias("c1"))
    b = placed.select(F.col("id").alias("dst"), F.col("cc_id").alias("c2"))
    sent = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return sent.agg(F.count("*").alias("messages"), F.coalesce(F.sum(hops(F.col("c1"), F.col("c2"), dim_x, dim_y, network)), F.lit(0)).alias("hops"))


def instruction_cycles(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """counts (one column for each kind of instruction) with cycles, their weighted sum."""
    weights = weights or INSTRUCTION
    return counts.withColumn("cycles", sum((F.col(k) * w for k, w in weights.items() if k in counts.columns), F.lit(0)).cast("long"))


def allocated(shapes: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row: objects of split lists (id, nodes) and further replicas (id, replicas)."""
    a = shapes.agg(F.sum("nodes").alias("list_objects"))
    b = replicas.agg(F.sum(F.col("replicas") - 1).alias("replica_objects"))
    return a.crossJoin(b)  # one row on each side
