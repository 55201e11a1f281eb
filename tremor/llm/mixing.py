"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each stream (a source; with weights, all without one together) is cut into blocks of equal mass in
a hashed order of its documents.  Block k of a stream of weight w is released at slot
floor(k / w) and due by slot ceil((k + 1) / w); earliest deadline first gives one block to
each slot, and every stream stays within one block of its share at every slot.  When a
stream has no blocks left, a new phase begins among the others with their weights scaled
up; no row is dropped or repeated.

Without weights every source is a stream of the same weight, whatever their number, and releases,
deadlines and the order by them are all made by DataFrames.  With weights the driver sees one total per stream and makes one cycle
of slots per phase, of the weights' common denominator, or as many as the phase has blocks.
Masses before a document come from sums by stream and salt, so a stream of any size is spread.

Null texts have mass 0, null sources count as the source '', repeated rows are placed each,
other columns stay out of the result.  An empty table gives no rows.
"""

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name, numbered

#: Hex digits of a document's hash that name its salt.
SALT_DIGITS = 3
BLOCK_CHARS = 1 << 16
REST = "(others)"


def source_of():
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def mass_of():
    return F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights, exact as they are written in decimal, as parts of their common denominator."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*[w.denominator for w in exact.values()])
    parts = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    return {s: x // common for s, x in parts.items()}


def one_cycle(parts: dict[str, int], left: dict[str, int]) -> tuple[dict[str, list[tuple[int, int, int]]], int]:
    """(slot, release, deadline) of each stream's blocks by earliest deadline first among released blocks, and the slots made.

    One cycle, or less if a stream has no block left before its end.
    """
    n = sum(parts.values())
    waiting, ready = [(0, s, 0) for s in sorted(parts)], []
    heapq.heapify(waiting)
    slots: dict[str, list[tuple[int, int, int]]] = {s: [] for s in parts}
    slot = 0
    while slot < n:
        while waiting and waiting[0][0] <= slot:
            released, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * n // parts[s]), s, k, released))
        due, s, k, released = heapq.heappop(ready)
        slots[s].append((slot, released, due))
        slot += 1
        if k + 1 == left[s]:
            break
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * n // parts[s], s, k + 1))
    return slots, slot


def schedule(blocks: dict[str, int], parts: dict[str, int]) -> list[dict]:
    """Per stream its phases: first block, blocks, first slot, cycle length, blocks and their slots, releases and deadlines in a cycle."""
    left, base = dict(blocks), 0
    phases: dict[str, list[dict]] = {s: [] for s in blocks}
    while left:
        own = {s: parts[s] for s in left}
        n, (cycle, length) = sum(own.values()), one_cycle(own, left)
        if length == n and all(left[s] > len(cycle[s]) for s in left):  # whole cycles until the first stream ends
            length = min((m - 1) // own[s] * n + cycle[s][(m - 1) % own[s]][0] for s, m in left.items()) + 1
            done = {s: length // n * own[s] + sum(x[0] < length % n for x in cycle[s]) for s in left}
            each = own
        else:
            n, done = length, {s: len(cycle[s]) for s in left}
            each = {s: max(1, len(cycle[s])) for s in left}
        for s in list(left):
            slots, releases, dues = ([x[i] for x in cycle[s]] for i in range(3))
            phases[s].append({"block": blocks[s] - left[s], "n": done[s], "base": base, "cycle": n, "each": each[s], "slots": slots, "releases": releases, "dues": dues})
            left[s] -= done[s]
            if left[s] <= 0:
                del left[s]
        base += length
    return [{"stream": s, "phases": p} for s, p in phases.items()]


def weighted_slots(spark, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """(stream, block, slot, release, deadline) of all blocks of streams with weights."""
    plan = [{"stream": p["stream"], **x} for p in schedule(blocks, whole_weights(weights)) for x in p["phases"] if x["n"]]
    form = "array<struct<stream string, block bigint, n bigint, base bigint, cycle bigint, each bigint, slots array<bigint>, releases array<bigint>, dues array<bigint>>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), form)).alias("p")).select("p.*")
    at = lambda name: f"base + (k div each) * cycle + {name}[cast(k % each as int)]"
    one = f"transform(sequence(0L, n - 1), k -> struct(block + k as block, {at('slots')} as slot, {at('releases')} as release, {at('dues')} as deadline))"
    return table.select("stream", F.explode(F.expr(one)).alias("b")).select("stream", "b.*")


def equal_windows(blocks: DataFrame) -> DataFrame:
    """(block, release, deadline) of (stream, n_blocks), any number of streams of one weight.

    A phase ends with the streams that have the fewest blocks.  Of its m streams each weighs w = 1 / m, so block k
    of the phase is released at its first slot plus floor(k / w) and due by that plus ceil((k + 1) / w).
    """
    ends = blocks.groupBy(F.col("n_blocks").alias("end")).agg(F.count("*").alias("ending"))  # a row a phase
    by = Window.orderBy("end")
    phases = ends.select("end", F.coalesce(F.lag("end").over(by), F.lit(0)).alias("first"), F.sum("ending").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("m"))
    made = F.col("m") * (F.col("end") - F.col("first"))
    phases = phases.withColumn("base", F.coalesce(F.sum(made).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rounds = phases.select("first", "base", "m", F.explode(F.expr("sequence(first, end - 1)")).alias("block"))
    k = F.col("block") - F.col("first")
    return rounds.select("block", (F.col("base") + k * F.col("m")).alias("release"), (F.col("base") + (k + 1) * F.col("m")).alias("deadline"))


def equal_slots(blocks: DataFrame) -> DataFrame:
    """(stream, block, slot, release, deadline) of (stream, n_blocks), any number of streams of one weight.

    Earliest deadline first, equal ones by stream: windows of one weight are the same or apart, so at each slot
    all blocks due before have theirs, and the earliest deadline left is one that is released.
    """
    every = blocks.select("stream", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    due = cut(every.join(equal_windows(blocks).hint("merge"), "block"))
    return numbered(due, "slot", "deadline", "stream").select("stream", "block", "slot", "release", "deadline")


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, source, mass, stream, block, slot, release, deadline, offset (mass before it in its block).

    weights: by source, others together as ``REST``; None: equal ones, each source a stream.  Order rows by slot and offset.
    """
    source, mass = source_of(), mass_of()
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), mass.cast("string")))
    rows = docs.select(F.col("doc_id"), source.alias("source"), mass.alias("mass"), hashed.alias("hash"))
    stream = F.col("source")
    if weights is not None:
        stream = F.when(stream.isin([s for s in weights if s != REST]), stream).otherwise(REST)
    rows = rows.withColumn("stream", stream).withColumn("salt", F.substring("hash", 1, SALT_DIGITS))
    sums = cut(rows.groupBy("stream", "salt").agg(F.sum("mass").alias("sum")))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.sum("sum") / block_chars)).cast("long").alias("n_blocks")
    blocks = sums.groupBy("stream").agg(n_blocks)
    if weights is None:
        slots = equal_slots(blocks)
    else:
        found = {r["stream"]: r["n_blocks"] for r in blocks.collect()} or {REST: 1}
        slots = weighted_slots(docs.sparkSession, found, {s: weights.get(s, min(weights.values())) for s in found})
    slots = cut(slots)

    before = Window.partitionBy("stream").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("stream", "salt", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before")).join(blocks, "stream")
    own = Window.partitionBy("stream", "salt").orderBy("hash", "doc_id", "mass").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("within", F.coalesce(F.sum("mass").over(own), F.lit(0)))
    out = out.join(starts.hint("merge"), ["stream", "salt"]).withColumn("start", F.col("before") + F.col("within"))
    out = out.withColumn("block", F.least(F.floor(F.col("start") / block_chars).cast("long"), F.col("n_blocks") - 1)).join(slots.hint("merge"), ["stream", "block"])
    offset = (F.col("start") - F.col("block") * block_chars).alias("offset")
    return out.select("doc_id", "source", "mass", "stream", "block", "slot", "release", "deadline", offset)


def in_order(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with its columns, in the order of the schedule (over partitions and within them).

    Places are found without the texts, which move twice: to meet their place, and to it.
    Equal rows share the first place of theirs.
    """
    names, place = docs.columns, free_name(docs, "place")
    first = placed(docs, weights, block_chars).groupBy("doc_id", "source", "mass").agg(F.min(F.struct("slot", "offset")).alias(place))
    id_, source, mass = (free_name(docs, n) for n in ("id_of", "source_of", "mass_of"))
    first = cut(first.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("mass").alias(mass), place))
    where = F.col("doc_id").eqNullSafe(F.col(id_)) & (source_of() == F.col(source)) & (mass_of() == F.col(mass))
    out = docs.join(first.hint("merge"), where)
    order = [f"{place}.slot", f"{place}.offset", "doc_id"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
