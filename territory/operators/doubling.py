"""Walks in a forest by pointer doubling: after each round every row points twice as far up.

A forest of any size and of depth d takes about log2(d) self-joins, each over a written table with a row for each node
(or, for all pairs, over the pairs found so far), so neither rows nor levels are limited.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from territory.storage import Tables

#: Members of a cycle that an error names.
NAMED = 10


class CycleError(ValueError):
    """Nodes that are, in the end, above themselves."""

    def __init__(self, members: list[str]) -> None:
        super().__init__(f"a cycle goes through {', '.join(map(str, members))}")
        self.members = members


def fold(nodes: DataFrame, combine: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]], keep: Column | None = None, cycles: str = "raise") -> DataFrame:
    """What each node gathers on its way up.

    `nodes` has id (unique), up (the node above, or null) and any other columns, which hold what a node knows of itself. A round
    replaces each column by combine[column](own, above), functions that give a column of the node and of the one it points
    to, where that is null if there is none; columns without one stay. `up` may be combined too: by default it becomes the pointer above.
    Rows where `keep` is false, after a round, are dropped: they must have nothing that others need. Rows
    whose pointers can't end, as they run into a cycle, raise CycleError, or stay as they are with cycles="stop".
    """
    tables, state, n, reach = Tables(nodes.sparkSession), nodes, None, 1
    columns = [c for c in nodes.columns if c not in ("id", "up")]
    above_columns = [F.col(c).alias(f"__{c}") for c in ["id", "up", *columns]]
    own, above = F.col, lambda c: F.col(f"__{c}")
    while True:
        met = state.join(state.select(*above_columns), F.col("up") == F.col("__id"), "left")
        up = combine["up"](own, above) if "up" in combine else above("up")
        counted = Observation()
        met = met.select("id", up.alias("up"), *[combine[c](own, above).alias(c) if c in combine else F.col(c) for c in columns]).observe(counted, F.count(F.lit(1)).alias("n"))
        state, seen = tables.observed(met if keep is None else met.where(keep), "nodes", pointing=F.count("up"))
        n, reach = counted.get["n"] if n is None else n, reach * 2
        if not seen["pointing"]:
            return state
        if reach > n:
            if cycles == "stop":
                return state
            raise CycleError([r.up for r in state.where("up is not null").select("up").distinct().orderBy("up").limit(NAMED).collect()])


def pairs(nodes: DataFrame) -> DataFrame:
    """(id, above_id, depth): each node with each node above it, itself at depth 0 included.

    `nodes` has id (unique) and up; an `up` that isn't an id ends a way. A round joins the pairs of the greatest depth so far, which a node
    has one of, with all pairs, and writes only those that are new. A cycle raises CycleError.
    """
    tables = Tables(nodes.sparkSession)
    ids = nodes.select("id")
    self_ = ids.select("id", F.col("id").alias("above_id"), F.lit(0).alias("depth"))
    edges = nodes.where("up is not null").select("id", F.col("up").alias("above_id"), F.lit(1).alias("depth")).join(ids.select(F.col("id").alias("above_id")), "above_id", "left_semi")
    metrics = {"deepest": F.max("depth"), "looped": F.count_if(F.col("id") == F.col("above_id"))}
    last, seen = tables.observed(edges.select("id", "above_id", "depth"), "pairs", **metrics)
    found, reach = last, 1
    while True:
        if seen["looped"]:
            raise CycleError([r.id for r in last.where("id = above_id").select("id").distinct().orderBy("id").limit(NAMED).collect()])
        if seen["deepest"] != reach:
            break
        far = last.where(F.col("depth") == reach).select("id", F.col("above_id").alias("__via"))
        new = far.join(found.select(F.col("id").alias("__via"), "above_id", (F.col("depth") + reach).alias("depth")), "__via").select("id", "above_id", "depth")
        last, seen = tables.observed(new, "pairs", **metrics)
        found, reach = found.unionByName(last), 2 * reach
    return self_.unionByName(found)
