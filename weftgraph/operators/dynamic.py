"""Levels of a growing graph.

Only insertions; levels can fall. What new edges send at once (a hook: by default the level of
their source + 1) makes the first frontier, then the ordinary relaxation runs with a min merge.
The edges of an increment are added to those that are dealt and cached already, and the state
is a list of changes, so a step shuffles and writes what it changes and not the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .program import Links, State, better_of, combined, fixed_plans, keys, relax


def first_levels(spark, root: int) -> DataFrame:
    return spark.range(root, root + 1).select("id", F.lit(0).cast("long").alias("level"))


def continuations(levels: DataFrame, delta: DataFrame, on_insert: Column | None = None) -> DataFrame:
    """What new edges send at once: (id, value) = (dst, level(src) + 1) where src has a level, or what the
    hook on_insert gives, over level and the columns of delta."""
    value = (F.col("level") + 1) if on_insert is None else on_insert
    return delta.join(levels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), value.alias("value"))


class GrowingLevels:
    """Edges that come in increments, and the levels after each. on_insert and message: what a new
    edge and an edge of the frontier send, over value (of the source) and the columns of the edges. With a hook
    of its own on_insert the wave of an increment also goes through vertices that it does not improve: their
    edges may have sent the hook's value and never a message, so nothing says that what lies behind is as near."""

    def __init__(self, spark, root: int | None = None, edges: DataFrame | None = None, levels: DataFrame | None = None, message: Column | None = None, on_insert: Column | None = None):
        self.spark = spark
        self.message = F.col("value") + 1 if message is None else message
        self.hooked = on_insert is not None
        self.on_insert = on_insert if self.hooked else self.message
        self.links = None if edges is None else Links(edges, lambda df: df.distinct())
        self.increment = 0
        start = first_levels(spark, root) if levels is None else levels
        with fixed_plans(spark):
            self.state = State(start.select("id", F.col("level").alias("value")), *better_of("min"))

    def insert(self, delta: DataFrame) -> DataFrame:
        """(id, level) of the vertices that delta changes."""
        self.increment += 1
        new = Links(delta, lambda df: df.distinct())
        with fixed_plans(self.spark):
            # the state lies dealt by id as the new edges lie dealt by source: neither moves
            self.state.step(combined(self.state.rows().select("id", "value"), new, self.on_insert, self.state.pick), self.increment)
            self._keep(new)
            if not self.state.frontier().isEmpty():
                if self.hooked:
                    wave = State(self.state.frontier(), *better_of("min"))
                    relax(self.links, wave, self.message)
                    self.state.step(wave.rows().select("id", "value"), self.increment)
                    self.state.merge()
                else:
                    self.state.merge()
                    relax(self.links, self.state, self.message, mark=self.increment)
            return self.state.since(self.increment).withColumnRenamed("value", "level")

    def _keep(self, new: Links) -> None:
        if self.links is None:
            self.links = new
        else:
            self.links.plain += new.plain
            self.links.raw += new.raw
            self.links.cut += new.cut
            self.links.compact()

    def levels(self) -> DataFrame:
        with fixed_plans(self.spark):
            return cut(self.state.rows().select("id", F.col("value").alias("level")))

    def close(self) -> None:
        if self.links is not None:
            self.links.close()


def level_history(changes: list[DataFrame]) -> DataFrame:
    """(increment, id, level) after each increment, from 1, out of what each of them changed."""
    each = reduce(DataFrame.unionByName, [c.select(F.lit(k + 1).cast("long").alias("since"), "id", "level") for k, c in enumerate(changes)])
    last = F.sequence(F.col("since"), F.lit(len(changes)).cast("long"))
    return each.select("id", "level", F.explode(last).alias("increment")).groupBy("increment", "id").agg(F.min("level").alias("level"))


def apply_increment(edges: DataFrame, levels: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, levels) after delta; edges come back as the plain union. For many increments
    GrowingLevels keeps the edges where they are."""
    everything = edges.select("src", "dst").unionByName(delta.select("src", "dst"))
    state = GrowingLevels(edges.sparkSession, edges=edges.select("src", "dst"), levels=levels)
    try:
        state.insert(delta.select("src", "dst"))
        return everything, state.levels()
    finally:
        state.close()
