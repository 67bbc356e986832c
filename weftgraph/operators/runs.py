"""Reports over run records: best runs, speedups, comparisons, histograms, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cost_model


def with_cost(runs: DataFrame) -> DataFrame:
    """Benchmark rows with the modelled chip_area, totE and time as area_m, energy_m, time_m."""
    args = [F.col(c).cast("double") for c in ("total_cycles", "operons_moved", "actions_created", "actions_performed", "dim_x", "memory_cc")]
    mesh, torus = cost_model("MESH", *args), cost_model("TORUS", *args)
    pick = [F.when(F.col("network") == "TORUS", t).otherwise(m) for m, t in zip(mesh, torus, strict=True)]
    return runs.withColumns(dict(zip(("area_m", "energy_m", "time_m"), pick, strict=True)))


def best_runs(runs: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of least value in each group; ties by the columns of tie. One aggregation:
    the row travels inside the minimum."""
    rest = [c for c in runs.columns if c not in (*keys, value, *tie)]
    best = runs.groupBy(*keys).agg(F.min(F.struct(value, *tie, *rest)).alias("b"))
    return best.select(*keys, "b.*").select(*runs.columns)


def speedups(best: DataFrame, base: Column, value: str, keys: list[str]) -> DataFrame:
    """best with base (the value of the one row where base holds) and speedup."""
    one = best.where(base).agg(F.min(value).alias("base"))
    return best.crossJoin(F.broadcast(one)).select(*keys, value, "base", (F.col("base") / F.col(value)).alias("speedup"))


def compare(runs: DataFrame, a: Column, b: Column, keys: list[str], value: str) -> DataFrame:
    """Least value of rows a and of rows b by keys, with b's decrease in percent of a and
    a's surplus in percent of b."""
    both = runs.groupBy(*keys).agg(F.min(F.when(a, F.col(value))).alias("a"), F.min(F.when(b, F.col(value))).alias("b")).where("a is not null and b is not null")
    return both.select(*keys, "a", "b", ((F.col("a") - F.col("b")) * 100.0 / F.col("a")).alias("decrease"), ((F.col("b") - F.col("a")) * 100.0 / F.col("b")).alias("increase"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, n): equal bins from least to most, the last one closed; empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def activity(states: DataFrame, cells: int) -> DataFrame:
    """(cycle, active, percent) of states (cycle, cell, code)."""
    on = F.sum((F.col("code") > 0).cast("long"))
    return states.groupBy("cycle").agg(on.alias("active"), (on * 100.0 / cells).alias("percent"))


def deltas(series: DataFrame, key: str, value: str) -> DataFrame:
    """series with delta, the increase since the row before (the first: its value). Keys are
    rounds or increments, so the series is short."""
    w = Window.orderBy(key)
    return series.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def cell_totals(cells: DataFrame, sums: list[str], maxima: list[str]) -> DataFrame:
    return cells.agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def over_trials(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("trials"), F.avg(value).alias("mean"), F.min(value).alias("least"))
