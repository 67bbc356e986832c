"""Levels of a graph that arrives as a stream of edge files.

Each file is an increment and each micro-batch one file. A batch adds its edges, then
relaxes from what changed. State is a folder for each batch with edges and levels;
a batch that is replayed starts from the state before it and writes the same again, so a
restarted query ends with the same levels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dynamic import apply_increment, first_levels
from ..operators.fixpoint import bfs
from ..operators.layout import stream_chunks

SCHEMA = "src long, dst long, weight long"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class LevelStore:
    """Edges (one folder a batch, append only) and levels (the last two batches count)."""

    def __init__(self, spark: SparkSession, folder: str, root: int, keep: bool = True):
        """keep: whether the levels of all batches stay, for history(), or of the last two only."""
        self.spark, self.folder, self.root, self.keep = spark, folder.rstrip("/"), root, keep

    def edges(self, before: int) -> DataFrame:
        paths = [f"{self.folder}/edges/{k}" for k in range(before)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def levels(self, after: int) -> DataFrame:
        if after < 0:
            return first_levels(self.spark, self.root)
        return self.spark.read.schema("id long, level long").parquet(f"{self.folder}/levels/{after}")

    def channels(self, before: int) -> DataFrame:
        """(batch, channel, src, dst, weight) of the batches that were dealt over channels."""
        each = [self.spark.read.schema(SCHEMA + ", channel int").parquet(f"{self.folder}/edges/{k}").withColumn("batch", F.lit(k).cast("long")) for k in range(before)]
        return reduce(DataFrame.unionByName, each).select("batch", "channel", "src", "dst", "weight")

    def add(self, batch: DataFrame, k: int, relax: bool = True, dim_x: int | None = None) -> None:
        """dim_x: edges are dealt in equal runs over 2 dim_x channels, as I/O cells would read them."""
        batch = batch.select("src", "dst", "weight")
        if dim_x is not None:
            batch = stream_chunks(batch, ["src", "dst", "weight"], dim_x, batch.count())
        batch.write.mode("overwrite").parquet(f"{self.folder}/edges/{k}")
        delta = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/edges/{k}")
        levels = self.levels(k - 1)
        if relax:
            levels = apply_increment(self.edges(k), levels, delta)[1]
        levels.write.mode("overwrite").parquet(f"{self.folder}/levels/{k}")
        if not self.keep and k >= 2:  # a replay needs the state before it and no older one
            drop(self.spark, f"{self.folder}/levels/{k - 2}")

    def history(self, batches: int) -> DataFrame:
        """(increment, id, level), increments from 1."""
        out = None
        for k in range(batches):
            one = self.levels(k).select(F.lit(k + 1).cast("long").alias("increment"), "id", "level")
            out = one if out is None else out.unionByName(one)
        return out


def stream_levels(
    spark: SparkSession, source: str, root: int, folder: str, relax: bool = True, one_based: bool = True, keep: bool = True, on_batch: Callable[[int, LevelStore], None] | None = None, dim_x: int | None = None
):
    """Starts the query and returns (query, store). Files are taken one at a time in order
    of their modification times. relax=False only ingests; levels can then be found at the
    end by deferred()."""
    store = LevelStore(spark, folder, root, keep)
    shift = 1 if one_based else 0
    raw = spark.readStream.schema(SCHEMA).option("sep", "\t").option("maxFilesPerTrigger", 1).csv(source)
    edges = raw.select((F.col("src") - shift).alias("src"), (F.col("dst") - shift).alias("dst"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))

    def step(batch: DataFrame, k: int) -> None:
        store.add(batch, k, relax, dim_x)
        if on_batch:
            on_batch(k, store)

    query = edges.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    return query, store


def deferred(store: LevelStore, batches: int) -> DataFrame:
    """Levels after all batches by one static search."""
    return bfs(store.edges(batches), store.root)
