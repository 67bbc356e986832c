"""Command line: python -m weftgraph bfs -f graph -root 0 -verify golden -o out"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import fixpoint, verify
from .sources import readers

APPS = ("bfs", "sssp", "pagerank", "components")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftgraph", description="Graph queries on edge list files.")
    p.add_argument("app", choices=APPS)
    p.add_argument("-f", required=True, help="edge list")
    p.add_argument("-root", type=int, default=0)
    p.add_argument("-iter", type=int, default=20, help="iterations of pagerank")
    p.add_argument("-hops", type=int, default=None, help="most edges of a path")
    p.add_argument("-salt", type=int, default=0, help="replicas of popular vertices")
    p.add_argument("-verify", default=None, help="golden file to compare with")
    p.add_argument("-o", default=None, help="where the result is written, as Parquet; printed if missing")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    edges, n = readers.read_edge_list(spark, a.f)
    ids = spark.range(n)
    if a.app in ("bfs", "sssp"):
        found = {"bfs": fixpoint.bfs, "sssp": fixpoint.sssp}[a.app](edges, a.root, a.hops, ids, a.salt)
    else:
        found = fixpoint.pagerank(edges, ids, a.iter, salt=a.salt) if a.app == "pagerank" else fixpoint.components(edges, ids)
    if a.o:
        found.write.mode("overwrite").parquet(a.o)
    else:
        found.orderBy("id").show(50)
    if a.verify:
        column = found.columns[1]
        golden = readers.read_scores(spark, a.verify) if a.app == "pagerank" else fixpoint.with_all(readers.read_golden(spark, a.verify, column)[0], ids, column)
        compare = verify.verify_tolerance if a.app == "pagerank" else verify.verify_exact
        errors = verify.summary(compare(found, golden, column)).first().errors
        print(f"{errors} errors")
        return int(errors > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
