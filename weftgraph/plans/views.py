"""Graphs in the relational tables, on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order; a directed multigraph."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").cast("long").alias("weight")).where("dst is not null")


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): parts to their suppliers, whose ids follow those of the parts."""
    n = table(spark, sf_dir, "part").count()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))
    ids = parts(spark, sf_dir).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + n))
    return edges, ids


def geo_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): region to nations to customers; ids r, 5 + n, 30 + c."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 5).cast("long").alias("dst"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 5).cast("long").alias("src"), (F.col("c_custkey") + 30).alias("dst"))
    edges = nation.union(customer).withColumn("weight", F.lit(1).cast("long"))
    ids = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id")).union(nation.select("dst")).union(customer.select("dst"))
    return edges, ids


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nth, src, dst): users of events that follow each other in time. Events are numbered
    by ranges of time and each is joined with its successor, so no task sorts all."""
    events = ordinal(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"])
    here, there = events.select("nth", F.col("user_id").alias("src")), events.select((F.col("nth") - 1).alias("nth"), F.col("user_id").alias("dst"))
    return here.join(there, "nth")


def user_increments(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, int]:
    """((increment, src, dst), root): k equal runs of the steps, and the first event's user."""
    steps = user_steps(spark, sf_dir)
    n = steps.count()
    root = steps.where("nth = 0").first().src
    return steps.select((F.floor(F.col("nth") * k / n) + 1).cast("long").alias("increment"), "src", "dst"), root


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct undirected pairs of the steps, as edges in one direction."""
    return user_steps(spark, sf_dir).where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))
