"""The call graph: symbols (id, fq_path, crate_name, span, characteristics) and edges (src, dst, kind).

A target is a boundary if it is no symbol, or a foreign one.  Walks treat boundary nodes as
leaves that are not part of the answer.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import VIRTUAL
from ..storage import written

FORWARD, BACKWARD = "forward", "backward"
#: Edges (two numbers each) up to which a walk from one node runs in a single task, in one job; beyond, level by level.
ONE_TASK_EDGES = 2_000_000


class CallGraph:
    def __init__(self, symbols: DataFrame, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES):
        self.symbols, self.one_task_edges = symbols, one_task_edges
        flags = symbols.select("id", F.col("characteristics.foreign").alias("foreign"))
        ends = edges.select("src", "dst", "kind")
        for end in ("src", "dst"):
            known = flags.select(F.col("id").alias(end), F.col("foreign").alias(f"{end}_foreign"))
            ends = ends.join(known, end, "left").withColumn(f"{end}_absent", F.col(f"{end}_foreign").isNull())
            ends = ends.withColumn(f"{end}_boundary", F.coalesce(f"{end}_foreign", F.lit(True)))
        self.edges = ends.drop("src_foreign", "dst_foreign").persist()
        self._small = None

    def release(self) -> None:
        """Gives back the memory of the edges; the graph stays usable."""
        self.edges.unpersist()

    def small(self) -> bool:
        if self._small is None:
            simple = isinstance(self.symbols.schema["id"].dataType, LongType)
            self._small = simple and self.edges.limit(self.one_task_edges + 1).count() <= self.one_task_edges
        return self._small

    def steps(self, direction: str) -> DataFrame:
        """(at, next, boundary of next): the edges as walked."""
        at, to = ("src", "dst") if direction == FORWARD else ("dst", "src")
        return self.edges.select(F.col(at).alias("at"), F.col(to).alias("next"), F.col(f"{to}_boundary").alias("leaf"))

    def closure(self, start, direction: str) -> DataFrame:
        """(id) of what a walk from ``start`` reaches; the start only if a cycle comes back to it."""
        usable = self.steps(direction).filter("not leaf").select("at", "next")
        return self._one_task(usable, start) if self.small() else self._by_level(usable, start)

    def _one_task(self, steps: DataFrame, start) -> DataFrame:
        def run(batches):
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if not parts:
                return
            at, to = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(at, kind="stable")
            at, to = at[order], to[order]
            reached, frontier = np.zeros(0, dtype=np.int64), np.array([start], dtype=np.int64)
            while len(frontier):
                lo, hi = np.searchsorted(at, frontier, "left"), np.searchsorted(at, frontier, "right")
                found = np.unique(np.concatenate([to[a:b] for a, b in zip(lo, hi, strict=True)] or [to[:0]]))
                frontier = np.setdiff1d(found, reached, assume_unique=True)
                reached = np.union1d(reached, frontier)
            yield pa.RecordBatch.from_arrays([pa.array(reached)], ["id"])

        return steps.repartition(1).mapInArrow(run, "id long")  # only the edges meet in one task, what makes them does not

    def _by_level(self, steps: DataFrame, start) -> DataFrame:
        kind = self.symbols.schema["id"].dataType
        first = self.edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"))
        return closed(first, steps)

    def scanned(self, start, reached: DataFrame, direction: str) -> DataFrame:
        """The edges that a walk looks at: out of (or into) the start and all it reached."""
        at = "src" if direction == FORWARD else "dst"
        walked = reached.select(F.col("id").alias(at)).union(self.symbols.sparkSession.range(1).select(F.lit(start).cast(self.symbols.schema["id"].dataType))).distinct()
        return self.edges.join(walked, at, "left_semi")

    def named(self, ids: DataFrame) -> DataFrame:
        """Symbols of ids, which stay as often as they come; unknown ids go."""
        return ids.join(self.symbols, "id")


#: Levels of a walk that are kept as tables of their own before they are written as one.
LEVELS = 8


def closed(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(id) of what steps (at, next) reach from ``start`` (id), level by level; a start only if a step comes to it."""
    steps = steps.distinct().persist()
    frontier, levels = start, []
    while True:
        found = steps.join(frontier, steps["at"] == frontier["id"]).select(F.col("next").alias("id")).distinct()
        for level in levels:
            found = found.join(level, "id", "left_anti")
        frontier = written(found)
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) == LEVELS:
            levels = [written(union(levels))]
    steps.unpersist()
    return union(levels) if levels else frontier


def union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    return every


def reached_from(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of ``start`` (id) and all that edges (src, dst) reach from it."""
    start = written(start.distinct())
    return start.union(closed(start, edges.select(F.col("src").alias("at"), F.col("dst").alias("next")))).distinct()


def flags(edges: DataFrame) -> DataFrame:
    """One row over scanned edges: over_approximated, implementor_count, boundary_applies."""
    virtual = F.col("kind") == VIRTUAL
    return edges.agg(
        F.coalesce(F.bool_or(virtual), F.lit(False)).alias("over_approximated"),
        F.count_distinct(F.when(virtual, F.col("dst"))).alias("implementor_count"),
        F.coalesce(F.bool_or("dst_boundary"), F.lit(False)).alias("boundary_applies"),
    )
