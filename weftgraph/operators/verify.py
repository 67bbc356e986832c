"""Comparison of results with golden tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(computed: DataFrame, golden: DataFrame, column: str) -> DataFrame:
    a = computed.select("id", F.col(column).alias("computed"), F.lit(True).alias("has"))
    b = golden.select("id", F.col(column).alias("golden"), F.lit(True).alias("should"))
    return a.join(b, "id", "full")


def _status(j: DataFrame, wrong) -> DataFrame:
    status = F.when(F.col("should").isNull(), "extra").when(F.col("has").isNull(), "missing").when(wrong, "wrong").otherwise("ok")
    return j.select("id", "computed", "golden", status.alias("status"))


def verify_exact(computed: DataFrame, golden: DataFrame, column: str) -> DataFrame:
    """(id, computed, golden, status): ok, wrong, missing or extra, for ids of either side."""
    return _status(_joined(computed, golden, column), ~F.col("computed").eqNullSafe(F.col("golden")))


def verify_tolerance(computed: DataFrame, golden: DataFrame, column: str, tol: float = 1e-5) -> DataFrame:
    return _status(_joined(computed, golden, column), F.coalesce(F.abs(F.col("computed") - F.col("golden")) > tol, F.lit(True)))


def summary(checked: DataFrame) -> DataFrame:
    """One row: rows, errors, and the largest difference."""
    diff = F.abs(F.col("computed") - F.col("golden")).cast("double")
    return checked.agg(F.count("*").alias("n"), F.sum((F.col("status") != "ok").cast("long")).alias("errors"), F.max(diff).alias("largest"))
