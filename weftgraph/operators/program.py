"""vertex_program: the loop behind the monotone fixpoint queries, and Links, its edge store.

Edges are dealt by source once and stay cached; a source with very many edges is cut into
parts by target, so no task holds all of a hub. Each round joins the frontier with the
out-edges, combines the messages of a vertex (partially before the shuffle), keeps those that
improve its state and makes them the next frontier. The state is dealt by id and is compared where it
lies: a round shuffles messages only and writes what changed since the whole state was last
written, which is done every MERGE rounds.

Loops run with fixed plans: both sides of every join are dealt alike, which adaptive execution
would undo by coalescing, and hubs are cut here instead of by its skew join.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

MERGE = 8
#: A source with fewer edges than this is never cut into parts.
LEAST_HUB = 4_096
#: Tables of Links after which they become one.
TABLES = 16
#: Edges up to which a table is filled by its first use and not by a job of its own.
SOON = 1_000_000


@contextmanager
def fixed_plans(spark: SparkSession):
    """Without adaptive execution and without broadcasts by estimated size, in this block."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keys(df: DataFrame, *names: str) -> DataFrame:
    """df without rows in which one of names is null, and these columns marked as never null (so
    that no filter comes between a cached table and a join, which would cost the union its partitioning)."""
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    return df.where(some).select(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) if c in names else F.col(c) for c in df.columns])


def hubs(edges: DataFrame, parts: int, least: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(src, edges, parts) of the sources with more than a quarter of the edges of an average
    partition (at most 4 * parts of them, with at most 8 * parts parts in all), and how many edges there are."""
    least = LEAST_HUB if least is None else least
    each = edges.groupBy("src").agg(F.count("*").alias("n"))
    total, most = each.agg(F.sum("n"), F.max("n")).first()
    limit = max(least, (total or 0) // (4 * parts))
    if not total or most <= limit:
        return [], total or 0
    return [(r.src, r.n, -(-r.n // limit)) for r in each.where(F.col("n") > limit).collect()], total


class Links:
    """Cached edges, dealt by source, to which more can be added."""

    def __init__(self, edges: DataFrame, dedupe: Callable[[DataFrame], DataFrame] | None = None, least: int | None = None, out: bool = False):
        """dedupe: applied to the edges of each source (or part of one) where they lie. out:
        adds the column out, the number of edges of the source."""
        self.spark = edges.sparkSession
        self.n = partitions(self.spark)
        self.dedupe, self.least, self.out = dedupe or (lambda df: df), least, out
        self.plain: list[DataFrame] = []
        self.raw: list[DataFrame] = []
        self.cut: list[tuple[DataFrame, DataFrame]] = []
        self.add(edges)

    def add(self, edges: DataFrame) -> None:
        raw = keys(edges, "src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
        with fixed_plans(self.spark):
            found, total = hubs(raw, self.n, self.least)
            rest = raw
            if found:
                named = self.spark.createDataFrame(found, "src long, out long, parts long")
                rest = raw.join(F.broadcast(named.select("src")), "src", "left_anti")
                own = raw.join(F.broadcast(named), "src").withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts"))).drop("parts")
                own = self.dedupe(keys((own if self.out else own.drop("out")).repartition(self.n, "src", "part"), "src", "part")).persist(StorageLevel.MEMORY_AND_DISK)
                own.count()
                self.cut.append((own, cut(named.select("src", "parts"))))
            table = self.dedupe(rest.repartition(self.n, "src"))
            if self.out:
                table = table.join(rest.repartition(self.n, "src").groupBy("src").agg(F.count("*").alias("out")), "src")
            self.plain.append(table.persist(StorageLevel.MEMORY_AND_DISK))
            if total > SOON:
                table.count()
        if total > SOON:
            raw.unpersist()
        else:
            self.raw.append(raw)  # its table is filled by its first use
        self.compact()

    def compact(self) -> None:
        """Many small tables become one, each row where it is."""
        if len(self.plain) > TABLES:
            with fixed_plans(self.spark):
                one = reduce(DataFrame.unionByName, self.plain).persist(StorageLevel.MEMORY_AND_DISK)
                one.count()
            for t in self.plain:
                t.unpersist()
            self.plain = [one]

    def join(self, frontier: DataFrame) -> DataFrame:
        """The rows of frontier (with the column src) beside the out-edges of src."""
        out = frontier.join(reduce(DataFrame.unionByName, self.plain), "src")
        for own, named in self.cut:
            each = frontier.join(F.broadcast(named), "src").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
            out = out.unionByName(each.join(own, ["src", "part"]).drop("part"))
        return out

    def close(self) -> None:
        for t in [*self.plain, *self.raw, *(t for t, _ in self.cut)]:
            t.unpersist()


def combined(frontier: DataFrame, links: Links, message: Column, pick, salt: int = 0) -> DataFrame:
    """(id, value): what the frontier (id, value) sends, combined for each target. salt: in two
    phases over so many replicas of a target."""
    sent = links.join(frontier.selectExpr("id AS src", "value")).select(F.expr("dst AS id"), message.alias("value"), "src")
    best = pick("value").alias("value")
    if salt:
        sent = sent.groupBy("id", F.expr(f"pmod(xxhash64(src), {salt}) AS replica")).agg(best)
    return sent.groupBy("id").agg(best)


def better_of(combine: str, improves=None):
    """The aggregate of combine (min or max), and whether a message changes a state."""
    pick = {"min": F.min, "max": F.max}[combine]
    return pick, improves or ((lambda new, old: new < old) if combine == "min" else (lambda new, old: new > old))


class State:
    """Values of vertices (id, value), dealt by id: base, and the few that changed since base was
    written. since: the mark of the last change; fresh: changed in the last step. Column
    expressions are built once and used in every step."""

    def __init__(self, start: DataFrame, pick, improves, mark: int = 0):
        self.pick, self.base, self.steps = pick, None, 0
        self.recent = cut(keys(start, "id").groupBy("id").agg(pick("value").alias("value")).select("id", "value", F.lit(mark).alias("since"), F.lit(True).alias("fresh")))
        kind = self.recent.schema["value"].dataType.simpleString()
        self._new = [F.expr(x) for x in ("id", "value AS new", f"CAST(NULL AS {kind}) AS old", "CAST(NULL AS INT) AS since")]
        self._recent = [F.expr(x) for x in ("id", f"CAST(NULL AS {kind}) AS new", "value AS old", "since")]
        self._base = [F.expr(x) for x in ("id", f"CAST(NULL AS {kind}) AS new", "value AS old", "CAST(NULL AS INT) AS since")]
        self._all = [pick("new").alias("new"), pick("old").alias("old"), F.expr("max(since) AS since")]
        better = F.expr("new IS NOT NULL") & (F.expr("old IS NULL") | improves(F.col("new"), F.col("old")))
        self._better = ["id", "new", "old", "since", F.coalesce(better, F.lit(False)).alias("fresh")]
        self._kept, self._fresh, self._row = F.expr("fresh OR since IS NOT NULL"), F.col("fresh"), [F.col("id"), F.col("value")]
        self._merge = [pick("value").alias("value"), F.expr("max(since) AS since")]

    def step(self, best: DataFrame, mark: int = 0) -> None:
        """Takes in the messages best (id, value) that improve the state. One aggregation over tables that are
        dealt alike, so the state does not move; what is written is what changed since base."""
        tagged = best.select(*self._new).union(self.recent.select(*self._recent))
        if self.base is not None:
            tagged = tagged.union(self.base.select(*self._base))
        changed = tagged.groupBy("id").agg(*self._all).select(*self._better).where(self._kept)
        self.recent = cut(changed.selectExpr("id", "if(fresh, new, old) AS value", f"if(fresh, {mark}, since) AS since", "fresh"))
        self.steps += 1

    def frontier(self) -> DataFrame:
        return self.recent.where(self._fresh).select(*self._row)

    def rows(self) -> DataFrame:
        """(id, value, since) of all vertices that have a value."""
        own = self.recent.select("id", "value", "since")
        return own if self.base is None else self.base.union(own).groupBy("id").agg(*self._merge)

    def merge(self) -> None:
        """Writes base anew; only the fresh rows stay recent."""
        if self.steps >= MERGE:
            self.base = cut(self.rows())
            self.recent = self.recent.where(self._fresh)
            self.steps = 0

    def since(self, mark: int) -> DataFrame:
        """(id, value): what changed under this mark or a later one."""
        own = self.recent.select("id", "value", "since")
        return (own if self.base is None else self.base.unionByName(own)).where(F.col("since") >= mark).groupBy("id").agg(self.pick("value").alias("value"))


def relax(links: Links, state: State, message: Column, max_rounds: int | None = None, salt: int = 0, on_round=None, mark: int = 0) -> None:
    """Rounds from the fresh rows of state until nothing improves or max_rounds are done. Under fixed_plans."""
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        frontier = state.frontier()
        state.step(combined(frontier, links, message, state.pick, salt), mark)
        rounds += 1
        better = state.frontier()
        if on_round:
            on_round(rounds, frontier, better)
        if better.isEmpty():
            return
        state.merge()


def vertex_program(
    edges: DataFrame | Links,
    seed: DataFrame,
    message: Column,
    combine: str = "min",
    improves: Callable[[Column, Column], Column] | None = None,
    max_rounds: int | None = None,
    state: DataFrame | None = None,
    salt: int = 0,
    on_round: Callable[[int, DataFrame, DataFrame], None] | None = None,
) -> DataFrame:
    """(id, value) at the fixpoint. seed: first frontier (id, value). message: the value sent
    along an edge, over the columns value and weight. combine: min or max of a
    vertex's messages. improves(new, old): whether a message changes a state.
    state: states that hold before the loop. salt: combine in two phases over so many
    replicas of a target. on_round(k, frontier, improved) sees each round."""
    pick, improves = better_of(combine, improves)
    links = edges if isinstance(edges, Links) else Links(edges)
    try:
        with fixed_plans(links.spark):
            held = State(seed, pick, improves)
            if state is not None:
                held.base = cut(keys(state.select("id", "value"), "id").groupBy("id").agg(pick("value").alias("value")).withColumn("since", F.lit(0)))
            relax(links, held, message, max_rounds, salt, on_round)
            return cut(held.rows().select("id", "value"))
    finally:
        if links is not edges:
            links.close()
