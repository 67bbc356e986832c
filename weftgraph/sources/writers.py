"""Writers of graph files, golden files and reports.

Formats with a header are one file by definition: lines are sorted by their place and
written from one task. Tables that are only to be read by Spark again should stay Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dynamic import GrowingLevels
from ..operators.graph import csr
from . import readers
from .generators import with_weights


def _line(*columns: Column, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[c.cast("string") for c in columns])


def write_lines(parts: list[DataFrame], path: str) -> None:
    """parts: (place, line) each; written in order of part, then place."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), F.col("place").cast("long").alias("place"), "line")
        out = p if out is None else out.unionByName(p)
    out.repartition(1).sortWithinPartitions("part", "place", "line").select("line").write.mode("overwrite").text(path)


def _lines(df: DataFrame, lines: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "place long, line string")


def write_edge_list(edges: DataFrame, n: int, path: str, sep: str = "\t") -> None:
    m = edges.count()
    body = edges.select(F.col("src").alias("place"), _line(F.col("src"), F.col("dst"), F.col("weight"), sep=sep).alias("line"))
    write_lines([_lines(edges, [f"{n}{sep}{n}", str(m)]), body], path)


def write_golden(found: DataFrame, column: str, root: int, path: str) -> None:
    """Levels or distances, sorted by id, under a title line and the root."""
    write_lines([_lines(found, ["# Source", str(root)]), found.select(F.col("id").alias("place"), _line(F.col("id"), F.col(column)).alias("line"))], path)


def write_scores(found: DataFrame, path: str) -> None:
    write_lines([found.select(F.col("id").alias("place"), _line(F.col("id"), F.col("score")).alias("line"))], path)


def write_csr(edges: DataFrame, vertices: DataFrame, path: str, weighted: bool = True) -> None:
    """Compressed rows as text: name, n, m, offsets, targets and, if weighted, weights."""
    offsets, targets = csr(edges, vertices)
    head = ["WeightedAdjacencyGraph" if weighted else "AdjacencyGraph", str(vertices.count()), str(edges.count())]
    parts = [_lines(edges, head), offsets.select(F.col("id").alias("place"), _line(F.col("offset")).alias("line")), targets.select("place", _line(F.col("dst")).alias("line"))]
    write_lines(parts + ([targets.select("place", _line(F.col("weight")).alias("line"))] if weighted else []), path)


def write_frames(frames: DataFrame, dim_x: int, dim_y: int, path: str) -> None:
    """(cycle, row, col, code) as an animation file."""
    rows = frames.groupBy("cycle", "row").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("col", "code"))), lambda x: x["code"].cast("string"))).alias("cells"))
    lines = rows.groupBy(F.col("cycle").alias("place")).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"])).alias("line"))
    head = _lines(frames, [f"Cycles Dim_x Dim_y {frames.select('cycle').distinct().count()} {dim_x} {dim_y}", "frames"])
    write_lines([head, lines], path)


def write_report(report: DataFrame, path: str, mode: str = "append") -> None:
    """One CSV row for each run, with header; further runs are appended."""
    report.write.mode(mode).csv(path, header=True)


def write_sections(sections: dict[str, list[tuple[str, str]]], activity: DataFrame | None, cells: DataFrame | None, path: str) -> None:
    """A run statistics file: header and value lines of each section, then the series and the cells."""
    spark = (activity if activity is not None else cells).sparkSession
    head = [x for fields in sections.values() for x in ("\t".join(n for n, _ in fields), "\t".join(str(v) for _, v in fields))]
    parts = [spark.createDataFrame(list(enumerate(head)), "place long, line string")]
    if activity is not None:
        parts += [_lines(activity, ["Cycle#\tCells_Active_Percent\tHtree_Active_Percent"]), activity.select(F.col("cycle").alias("place"), _line(F.col("cycle"), F.col("cells"), F.col("htree")).alias("line"))]
    if cells is not None:
        parts += [_lines(cells, ["\t".join(cells.columns)]), cells.select(F.col("cc_id").alias("place"), _line(*[F.col(c) for c in cells.columns]).alias("line"))]
    write_lines(parts, path)


def run_name(*fields: Column | str) -> Column:
    """The configuration of a run as one file name."""
    return F.concat_ws("_", *[f if isinstance(f, Column) else F.lit(f) for f in fields])


def write_text(report: DataFrame, title: str, path: str, mode: str = "append") -> None:
    """A row of statistics as text: the title, then a line of name and value for each column. Further
    reports are appended as files of the same folder."""
    columns = report.columns
    named = F.array(*[F.concat_ws("\t", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in columns])
    report.select(F.explode(F.concat(F.array(F.lit(title)), named)).alias("line")).coalesce(1).write.mode(mode).text(path)


def convert(spark, source: str, target: str, kind: str = "matrix", seed: int = 1) -> int:
    """Rewrites a MatrixMarket or PaRMAT file as an edge list; returns the number of vertices."""
    read = {"matrix": readers.read_matrix, "parmat": readers.read_parmat}[kind]
    edges, n = read(spark, source, seed=seed)
    write_edge_list(with_weights(edges.select("src", "dst"), seed), n, target)
    return n


def cumulative(spark, increments: list[str], target: str, n: int, root: int = 0) -> None:
    """For each increment k (from 1) the edge list of all increments up to it at <target>_<k>, and the
    levels from root as a golden file beside it."""
    state = GrowingLevels(spark, root)
    try:
        for k in range(1, len(increments) + 1):
            write_edge_list(readers.read_cumulative(spark, increments[:k]), n, f"{target}_{k}", sep=" ")
            state.insert(readers.read_increment(spark, increments[k - 1]).select("src", "dst"))
            write_golden(state.levels(), "level", root, f"{target}_{k}.bfs")
    finally:
        state.close()
