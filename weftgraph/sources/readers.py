"""Readers of graph files, golden files and run files.

All go through Spark's readers, so any path that Spark opens will do. Bodies stay
distributed; only headers of a few lines reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import activity_class
from ..operators.fixpoint import UNREACHED
from ..operators.graph import ordinal

_SPACE = r"\s+"


def _head(spark: SparkSession, path: str, lines: int) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(lines).collect()]


def _fields() -> Column:
    return F.split(F.trim("value"), _SPACE)


def read_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vertices, edges) that an edge list states."""
    first, second = _head(spark, path, 2)
    return int(first.split()[0]), int(second.split()[0])


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(id) 0 to n - 1 by the header alone."""
    return spark.range(read_header(spark, path)[0])


def read_edge_list(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, int]:
    """(edges, n): lines after the two of the header are src dst [weight], white space
    between; weight 1 where there is none. check: their number must be the stated one."""
    n, m = read_header(spark, path)
    f = _fields()
    lines = _numbered(spark, path).where("nth >= 2 and trim(value) != ''")
    edges = lines.select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), F.coalesce(F.try_element_at(f, F.lit(3)).cast("long"), F.lit(1)).alias("weight"))
    if check and (found := edges.count()) != m:
        raise ValueError(f"{path} states {m} edges and has {found}")
    return edges, n


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with nth: the place in the file while it is one partition, growing
    with the place beyond; the first two lines have 0 and 1 in any case."""
    return spark.read.text(path).withColumn("nth", F.monotonically_increasing_id())


def read_increment(spark: SparkSession, paths: str | list[str], one_based: bool = True) -> DataFrame:
    """(src, dst, weight) of files without header."""
    schema = "src long, dst long, weight long"
    shift = 1 if one_based else 0
    raw = spark.read.csv(paths, sep="\t", schema=schema)
    return raw.select((F.col("src") - shift).alias("src"), (F.col("dst") - shift).alias("dst"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))


def read_cumulative(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct edges of several increments."""
    return read_increment(spark, paths).dropDuplicates(["src", "dst"])


def read_golden(spark: SparkSession, path: str, column: str, fill: bool = True) -> tuple[DataFrame, int]:
    """((id, column), root) of a file of levels or distances: a title line, the root, then rows.
    fill: ids up to the largest that the file lacks are UNREACHED."""
    _, root = _head(spark, path, 2)
    f = _fields()
    rows = _numbered(spark, path).where("nth >= 2").select(f[0].cast("long").alias("id"), f[1].cast("double").cast("long").alias(column)).where("id is not null")
    if not fill:
        return rows, int(root)
    top = rows.agg(F.max("id")).first()[0]
    ids = spark.range(0 if top is None else top + 1)
    return ids.join(rows, "id", "left").select("id", F.coalesce(column, F.lit(UNREACHED)).cast("long").alias(column)), int(root)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, score) of a PageRank file without header."""
    f = _fields()
    return spark.read.text(path).select(f[0].cast("long").alias("id"), f[1].cast("double").alias("score"))


def read_matrix(spark: SparkSession, path: str, one_based: bool = True, seed: int = 1) -> tuple[DataFrame, int]:
    """(edges, n) of a MatrixMarket file: % lines are comments, the first other line is
    the header. Weights are random from 1 to 5."""
    f = _fields()
    lines = spark.read.text(path).where("value not like '\\%%' and trim(value) != ''")
    head = lines.first().value
    shift = 1 if one_based else 0
    body = lines.withColumn("at", F.monotonically_increasing_id())
    first = body.agg(F.min("at")).first()[0]
    body = body.where(F.col("at") > first)
    return body.select((f[0].cast("long") - shift).alias("src"), (f[1].cast("long") - shift).alias("dst"), (F.floor(F.rand(seed) * 5) + 1).cast("long").alias("weight")), int(head.split()[0])


def read_parmat(spark: SparkSession, path: str, seed: int = 1) -> tuple[DataFrame, int]:
    return read_matrix(spark, path, one_based=False, seed=seed)


def read_digraph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) without repeated edges; of these the last line counts."""
    f = _fields()
    rows = _numbered(spark, path).where("nth >= 2").select("nth", f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), f[2].cast("double").alias("weight"))
    return rows.groupBy("src", "dst").agg(F.max_by("weight", "nth").alias("weight"))


def read_partition_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, block) of a file of 1-based vertices and their blocks."""
    raw = spark.read.csv(path, sep="\t", schema="id long, block int")
    return raw.select((F.col("id") - 1).alias("id"), "block")


_COUNTS = "trail total_cycles actions_created actions_performed actions_false_pred diffusions_created diffusions_performed diffusions_false_pred diffusions_filtered actions_overlaped diffusions_pruned operons_moved dim_x dim_y min_edges max_edges vicinity rpvo_max rhizome_cuttoff congestion_threshold_value memory_cc total_objects_created vertices edges recv_buff_size".split()
#: Columns of the benchmark CSV files, in their order (fixed by the files).
RUN_COLUMNS = (
    "trail network termination throttle recv_buff_size total_cycles actions_created actions_performed actions_false_pred diffusions_created "
    "diffusions_performed diffusions_false_pred avg_cells_active_percent diffusions_filtered actions_overlaped diffusions_pruned operons_moved "
    "dim_x dim_y min_edges max_edges vicinity pruning rpvo_max rhizome_cuttoff congestion_threshold_value memory_cc chip_area totE time "
    "avg_objects_per_cc total_objects_created vertices edges graph_file routing_algorithm"
).split()
_DOUBLES = {"avg_cells_active_percent", "chip_area", "totE", "time", "avg_objects_per_cc"}


def runs_schema() -> T.StructType:
    kind = lambda c: T.DoubleType() if c in _DOUBLES else T.LongType() if c in _COUNTS else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in RUN_COLUMNS])


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Benchmark rows, with app and graph from the name of their folder (graph_app)."""
    rows = spark.read.csv(paths, header=True, schema=runs_schema())
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumns({"graph": F.substring_index(folder, "_", 1), "app": F.substring_index(folder, "_", -1)})


def read_named(spark: SparkSession, pattern: str | list[str], fields: list[str]) -> DataFrame:
    """(path, fields...): files of one or more patterns with the parts of their names between _."""
    files = spark.read.format("binaryFile").load(pattern).select("path")  # names only: content is not read
    parts = F.split(F.element_at(F.split("path", "/"), -1), "_")
    return files.select("path", *[F.try_element_at(parts, F.lit(k + 1)).alias(c) for k, c in enumerate(fields)])


def read_statistics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sections of run statistics files: totals (one row of name and value for each header and
    value line pair), activity (cycle, cells, htree) and cells (one row each). Files are small and
    many: each is parsed whole by one task."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, text in zip(pdf.path, pdf.value, strict=True):
                lines = [x.split("\t") for x in text.splitlines() if x.strip()]
                k = 0
                while k < len(lines):
                    head = lines[k]
                    if head[0].startswith("Cycle"):
                        end = k + 1
                        while end < len(lines) and lines[end][0].strip().lstrip("-").isdigit() and len(lines[end]) <= 3:
                            end += 1
                        rows += [(file, "activity", j, str(n), v) for j, row in enumerate(lines[k + 1 : end]) for n, v in zip(("cycle", "cells", "htree"), row, strict=False)]
                        k = end
                    elif head[0] == "cc_id":
                        rows += [(file, "cells", j, n.strip(), v) for j, row in enumerate(lines[k + 1 :]) for n, v in zip(head, row, strict=False)]
                        break
                    elif k + 1 < len(lines):
                        rows += [(file, "totals", 0, n.strip(), v) for n, v in zip(head, lines[k + 1], strict=False)]
                        k += 2
                    else:
                        break
            yield pd.DataFrame(rows, columns=["path", "section", "nth", "name", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    long = files.mapInPandas(parse, "path string, section string, nth long, name string, value string")
    act = long.where("section = 'activity'").groupBy("path", "nth").pivot("name", ["cycle", "cells", "htree"]).agg(F.first("value"))
    return {
        "totals": long.where("section = 'totals'").select("path", "name", "value"),
        "activity": act.select("path", F.col("cycle").cast("long").alias("cycle"), F.col("cells").cast("double").alias("cells"), F.col("htree").cast("double").alias("htree")),
        "cells": long.where("section = 'cells'").select("path", F.col("nth").alias("cell"), "name", "value"),
    }


def in_order(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, nth, value): lines with their place, from 0, by file name and place in the file, however the
    files are split: by the offset of the split, then by the place in it."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return ordinal(lines, ["path", "block", "at"]).select("path", "nth", "value")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, row, col, code) of an animation file: two lines of header and label, then a
    line for each cycle with rows between commas and cells between spaces."""
    lines = ordinal(in_order(spark, path).where("nth >= 2 and trim(value) != ''"), ["nth"], "cycle")
    framed = lines.select("cycle", F.posexplode(F.split(F.trim("value"), r",\s*")).alias("row", "cells"))
    cells = framed.select("cycle", "row", F.posexplode(F.split(F.trim("cells"), _SPACE)).alias("col", "code"))
    return cells.where("code != ''").select("cycle", "row", "col", F.col("code").cast("int").alias("code"))


def frame_grid(frames: DataFrame) -> DataFrame:
    """(cycle, grid): each frame as an array of rows, each an array of the classes of its cells."""
    rows = frames.groupBy("cycle", "row").agg(F.array_sort(F.collect_list(F.struct("col", activity_class(F.col("code")).alias("class")))).alias("c"))
    return rows.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("row", F.col("c.class").alias("classes")))).alias("g")).select("cycle", F.col("g.classes").alias("grid"))


#: Fields of the names of run files, by their place between the underscores (fixed by the files).
NAME_FIELDS = {
    "app": 0, "graph": 2, "vertices": 4, "edges": 6, "rpvo_max": 8, "rhizome_cuttoff": 10, "trail": 12, "dim_x": 14, "dim_y": 16, "throttle": 20,
    "recvbuff": 22, "vicinity": 24, "ghosts_max": 27, "edges_min": 30, "edges_max": 33, "termination": 35, "network": 37, "pruning": 40,
}


def name_fields(path: Column) -> list[Column]:
    """The fields of a run file's name (of its folder, if Spark wrote it); null beyond its last part."""
    steps = F.split(path, "/")
    name = F.when(F.element_at(steps, -1).startswith("part-"), F.try_element_at(steps, F.lit(-2))).otherwise(F.element_at(steps, -1))
    parts = F.split(name, "_")
    return [F.try_element_at(parts, F.lit(k + 1)).alias(c) for c, k in NAME_FIELDS.items()]


def consolidate(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """One row of RUN_COLUMNS for each run statistics file of the patterns: its totals, the fields of its
    name and the cost model. One job whatever the number of files."""
    from ..operators.runs import with_cost

    named = {
        "actions_created": "total_actions_created", "actions_performed": "total_actions_performed_work", "actions_false_pred": "total_actions_false_on_predicate", "diffusions_performed": "diffusions_performed_work",
        "diffusions_false_pred": "diffusions_false_on_predicate", "memory_total": "total_chip_memory(bytes)", "congestion_threshold_value": "threshold",
    }
    read = [c for c in RUN_COLUMNS if c not in named] + [*named.values(), "total_compute_cells", "hx"]
    totals = read_statistics(spark, patterns)["totals"]
    wide = totals.groupBy("path").pivot("name", sorted(set(read))).agg(F.first("value"))
    back = {v: k for k, v in named.items()}
    wide = wide.select("path", *[F.col(f"`{c}`").alias(back.get(c, c)) for c in wide.columns if c != "path"])
    file = F.col("path")
    fields = {c.split(".")[-1]: x for c, x in zip(NAME_FIELDS, name_fields(file), strict=True)}
    values = {
        "trail": fields["trail"], "network": fields["network"], "termination": fields["termination"], "throttle": F.when(F.col("throttle").cast("long") > 0, "ON").otherwise("OFF"),
        "min_edges": fields["edges_min"], "max_edges": fields["edges_max"], "vicinity": fields["vicinity"], "pruning": fields["pruning"], "rpvo_max": fields["rpvo_max"], "rhizome_cuttoff": fields["rhizome_cuttoff"],
        "memory_cc": F.floor(F.col("memory_total").cast("double") / F.col("total_compute_cells").cast("double")), "routing_algorithm": F.lit("XY"),
    }
    schema = {f.name: f.dataType for f in runs_schema()}
    rows = wide.select(*[values.get(c, F.col(c)).cast(schema[c]).alias(c) for c in RUN_COLUMNS])
    made = with_cost(rows)
    return made.withColumns({"chip_area": F.col("area_m"), "totE": F.col("energy_m"), "time": F.col("time_m")}).select(*RUN_COLUMNS)
