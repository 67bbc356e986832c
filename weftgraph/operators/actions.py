"""Programs of message handlers: a vertex state of any columns, and what handlers do with messages.

A handler (Action) is made of column expressions, so a whole round stays inside Catalyst:
message, what is sent along an edge, by field; combine, how a vertex's messages are made one, by field
(min, max, sum, count, or any function from a column to an aggregate); gate, the number of messages
that has to be there before the vertex acts; predicate, whether it acts; work, the new values of
state columns; diffuse, whether it then sends. Predicate, work and diffuse see the state
columns, and the combined fields under the prefix m_ (null without messages) and m_count.

run() is one synchronous round after another: all vertices that diffused send, all that got
messages (or, with everyone=True, all) act. Germinating messages start it, or the column
active of the vertices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .program import Links, fixed_plans, keys, partitions

_COMBINE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def _true() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Action:
    message: dict[str, Column]
    combine: dict[str, str | Callable[[Column], Column]]
    work: dict[str, Column]
    predicate: Column = field(default_factory=_true)
    diffuse: Column = field(default_factory=_true)
    #: A column of the state: that many messages open the gate. None: any number does.
    gate: str | None = None


class Registry:
    """Handlers by number. The first numbers are the built-in ones: nothing happens on null, acknowledge
    and allocate (edges and vertices are allocated by Links), true always acts, error raises."""

    BUILT_IN = ("null", "true", "error", "allocate", "acknowledge")

    def __init__(self):
        self.actions: list[tuple[str, Action]] = []
        for name in self.BUILT_IN:
            acts = F.raise_error(F.lit("error event")).cast("boolean") if name == "error" else F.lit(name == "true")
            self.register(name, Action({}, {}, {}, predicate=acts, diffuse=F.lit(name == "error")))

    def register(self, name: str, action: Action) -> int:
        self.actions.append((name, action))
        return len(self.actions) - 1

    def __getitem__(self, key: int | str) -> Action:
        if isinstance(key, int):
            return self.actions[key][1]
        return next(a for n, a in reversed(self.actions) if n == key)


def run(
    action: Action, edges: DataFrame | Links, vertices: DataFrame, germinate: DataFrame | None = None, rounds: int | None = None, everyone: bool = False, on_round: Callable[[int, DataFrame], None] | None = None
) -> DataFrame:
    """vertices (id and state columns; active: boolean, which of them send first, none if it is missing)
    after the rounds, or when nothing diffuses any more. germinate: first messages (id and the fields)
    from the host. everyone: vertices act without messages too."""
    links = edges if isinstance(edges, Links) else Links(edges)
    columns = [c for c in vertices.columns if c not in ("id", "active")]
    fields = list(action.message)
    spark = vertices.sparkSession

    def combined(sent: DataFrame) -> DataFrame:
        made = []
        for f in fields:
            how = action.combine[f]
            made.append((_COMBINE[how] if isinstance(how, str) else how)(F.col(f)).alias(f"m_{f}"))
        return sent.groupBy("id").agg(*made, F.count(F.lit(1)).alias("m_count"))

    def acted(state: DataFrame, sent: DataFrame) -> DataFrame:
        both = state.join(combined(sent), "id", "left")
        got = F.coalesce("m_count", F.lit(0))
        ready = F.lit(True) if everyone else got > 0
        if action.gate is not None:
            ready = got >= F.col(action.gate)
        acts = F.coalesce(ready & action.predicate, F.lit(False))
        both = both.withColumn("weft_acts", acts)
        new = [F.when(F.col("weft_acts"), action.work[c]).otherwise(F.col(c)).cast(vertices.schema[c].dataType).alias(c) if c in action.work else F.col(c) for c in columns]
        made = both.select("id", *new, F.col("weft_acts"), *[f"m_{f}" for f in fields], "m_count")
        return made.select("id", *columns, F.coalesce(F.col("weft_acts") & action.diffuse, F.lit(False)).alias("active"))

    try:
        with fixed_plans(spark):
            active = F.col("active") if "active" in vertices.columns else F.lit(False)
            state = cut(keys(vertices.select("id", *columns, active.alias("active")), "id").repartition(partitions(spark), "id"))
            k = 0
            while rounds is None or k < rounds:
                sending = state.where("active")
                sent = links.join(sending.select(F.col("id").alias("src"), *columns)).select(F.col("dst").alias("id"), *[m.alias(f) for f, m in action.message.items()])
                if k == 0 and germinate is not None:
                    sent = sent.unionByName(germinate.select("id", *fields))
                state = cut(acted(state, sent))
                k += 1
                if on_round:
                    on_round(k, state)
                if rounds is None and state.where("active").isEmpty():
                    break
            return state.select("id", *columns)
    finally:
        if links is not edges:
            links.close()


def bfs_tree() -> Action:
    """Levels and the smallest parent on a shortest path; state: level, parent (both null at first)."""
    return Action(
        message={"level": F.col("level") + 1, "parent": F.col("src")},
        combine={"level": "min", "parent": "min"},
        predicate=F.col("level").isNull() | (F.col("m_level") < F.col("level")),
        work={"level": F.col("m_level"), "parent": F.col("m_parent")},
    )


def pagerank(n: int, damping: float = 0.85) -> Action:
    """One iteration a round; state: score, out (out-degree) and inn (in-degree), whose messages the gate
    awaits. With run(everyone=True)."""
    return Action(
        message={"share": F.col("score") / F.col("out")},
        combine={"share": "sum"},
        gate="inn",
        work={"score": (1 - damping) / n + damping * F.coalesce("m_share", F.lit(0.0))},
    )
