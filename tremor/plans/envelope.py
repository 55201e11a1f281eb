"""The envelope of every answer: data, total, truncated, and what is uncertain about it."""

import json
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISPATCH = "<dyn dispatch>"


@dataclass(frozen=True)
class Envelope:
    """data is JSON-like; stale and over_approximated leave the JSON when None."""

    data: object
    total: int
    truncated: bool = False
    over_approximated: dict | None = None
    boundary_applies: bool = False
    stale: dict | None = None
    fields: tuple = field(default=("data", "stale", "over_approximated", "truncated", "total", "boundary_applies"), repr=False)

    @staticmethod
    def exact(data, total=None):
        return Envelope(data, len(data) if total is None else total)

    def with_total(self, total):
        return replace(self, total=total)

    def with_truncated(self, truncated=True):
        return replace(self, truncated=truncated)

    def with_boundary(self, applies=True):
        return replace(self, boundary_applies=applies)

    def with_stale(self, files):
        return replace(self, stale={"diverged_files": list(files)} if files else None)

    def with_over_approximation(self, implementors, marker=DISPATCH):
        return replace(self, over_approximated={"DynDispatch": {"trait_path": marker, "implementor_count": implementors}})

    def remap(self, data):
        return replace(self, data=data)

    def to_json(self) -> str:
        left_out = ("stale", "over_approximated")
        return json.dumps({k: getattr(self, k) for k in self.fields if k not in left_out or getattr(self, k) is not None}, separators=(",", ":"), ensure_ascii=False, default=lambda x: int(x) if isinstance(x, Decimal) else str(x))


@dataclass
class Answer:
    """Lists of rows, each sorted and limited, and one row of facts: total, truncated and the flags.

    held: what stays in memory until ``release``.
    """

    lists: dict[str, DataFrame]
    facts: DataFrame
    held: tuple = ()

    @property
    def rows(self) -> DataFrame:
        return next(iter(self.lists.values()))

    def table(self) -> DataFrame:
        """All rows with the name of their list and the facts beside them; without rows the facts alone."""
        parts = [df.withColumn("list", F.lit(name)) for name, df in self.lists.items()]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return F.broadcast(self.facts).join(every, F.lit(True), "left")

    def release(self) -> None:
        for df in self.held:
            df.unpersist()

    def envelope(self) -> Envelope:
        data = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in self.lists.items()}  # limited lists
        f = self.facts.first()
        out = Envelope(next(iter(data.values())) if len(data) == 1 else data, f["total"], f["truncated"], boundary_applies=f["boundary_applies"])
        return out.with_over_approximation(f["implementor_count"]) if f["over_approximated"] else out
