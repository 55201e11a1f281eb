"""Best-fit packing of token sequences by a configuration linear program.

A document's ids are the tokenizer's and an end id; one longer than the sequence is cut into
full pieces, of which the first may be shorter.  Only the histogram of lengths reaches the
driver (one row per length at most).  Patterns (how many pieces of each length fill a
sequence) come from a covering program over the histogram, solved by multiplicative weights:
each round a knapsack over the lengths' weights finds the pattern worth most, and lengths
that are covered lose weight.  The fractional use of each pattern, or a share of it, is rounded, and what
that leaves over goes in best-fit decreasing; the share with the fewest sequences wins, none
of it (best-fit decreasing alone) included.  Any weights over what they make the best pattern
worth are a solution of the dual program, so the rounds also prove how few sequences there can
be at least.

Pieces then look up their place by their rank among those of their length; ranks come from
counts by length and salt, so no task sees all pieces of a length.

Null texts are empty and hold the end id alone; rows that share a doc_id are packed each;
other columns are ignored.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import lean
from .shared import cut, numbered
from .tokens import coder_for

LENGTH = 2048
END = b"\0\0\0\0"
SALTS = 256
ORDER = ("major", "minor")
ROUNDS = 300
#: Shares of the fractional solution that rounding keeps; the fewest sequences win.
SHARES = (1.0, 0.9, 0.7, 0.5, 0.3, 0.0)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, order: tuple = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and major and minor, its document's ``order`` if given."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *ORDER[: len(order)]]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(order)]

    def run(batches):
        coder = coder_for(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text, *at in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                ids = coder.ids(text.as_py() or "").tobytes() + END
                n = len(ids) // 4
                first = (n - 1) % length + 1
                start = 0
                for k, end in enumerate(range(first, n + 1, length)):
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), *at))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c.cast("long").alias(n) for c, n in zip(order, ORDER, strict=False)))
    return columns.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {n} long" for n in names[5:]))


def best_fit(counts: dict[int, int], length: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: (pattern, times).  Bins alike are handled together."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {length: []}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_bins if size <= r < length):
            if not left:
                break
            again = []
            for pattern, times in open_bins.pop(room):
                fit = room // size
                full = min(times, left // fit)
                rest = min(left - full * fit, fit) if full < times else 0
                for k, n in ((fit, full), (rest, 1 if rest else 0)):
                    if n:
                        new = pattern | {size: pattern.get(size, 0) + k}
                        open_bins.setdefault(room - k * size, []).append((new, n))
                        left -= k * n
                if times > full + (1 if rest else 0):
                    again.append((pattern, times - full - (1 if rest else 0)))
            if again:
                open_bins.setdefault(room, []).extend(again)
        fit = length // size
        for k, n in ((fit, left // fit), (left % fit, 1 if left % fit else 0)):
            if n:
                open_bins.setdefault(length - k * size, []).append(({size: k}, n))
    return [x for bins in open_bins.values() for x in bins]


def knapsack(sizes, value, limits, length):
    """(the multiset of sizes worth most within ``length``, cut to the limits; what it is worth uncut); sizes ascend."""
    best = np.zeros(length + 1)
    pick = np.full(length + 1, -1, dtype=np.int64)
    n_at = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for c in range(1, length + 1):
        n = n_at[c]
        if not n:
            continue
        worth = best[c - sizes[:n]] + value[:n]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], pick[c] = worth[k], k
        else:
            best[c], pick[c] = best[c - 1], -2
    pattern, c = {}, length
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
            continue
        k = int(pick[c])
        if pattern.get(k, 0) < limits[k]:
            pattern[k] = pattern.get(k, 0) + 1
        c -= int(sizes[k])
    return pattern, best[length]


def configuration(counts: dict[int, int], length: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """([(pattern, times)] that hold all pieces of the histogram ``counts``, number of sequences that any packing needs)."""
    least = bound = -(-sum(s * n for s, n in counts.items()) // length)
    sizes = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[s] for s in sizes], dtype=float)
    weight = np.ones(len(sizes))
    covered = np.zeros(len(sizes))
    chosen: dict[tuple, float] = {}
    step = least / rounds
    for t in range(rounds):
        pattern, worth = knapsack(sizes, sizes * weight, need, length)
        bound = max(bound, float(need @ (sizes * weight)) / worth)
        times = min([step, *(need[k] / a for k, a in pattern.items())])
        chosen[tuple(sorted(pattern.items()))] = chosen.get(tuple(sorted(pattern.items())), 0) + times
        for k, a in pattern.items():
            covered[k] += a * times
        # a length behind the share of rounds gone gains weight, one ahead loses it
        weight = np.exp(np.clip(4.0 * ((t + 1) / rounds - covered / need), -8, 8))
    solution = [({int(sizes[k]): a for k, a in p}, n) for p, n in chosen.items()]
    solution.sort(key=lambda x: (-max(x[0]), sorted(x[0].items())))
    full = [(p, n) for p, n in solution if sum(s * a for s, a in p.items()) >= length - 1]
    options = [rounded(counts, some, share, length) for some in (full, solution) for share in SHARES]
    return min(options, key=lambda packed: sum(n for _, n in packed)), math.ceil(bound - 1e-6)


def rounded(counts, solution, share, length):
    """A fractional solution with ``share`` of each pattern's use, rounded down, the rest in best-fit decreasing."""
    left = {int(s): int(n) for s, n in counts.items()}
    packed = []
    for pattern, times in solution:
        n = min([int(share * times + 0.5), *(left[s] // a for s, a in pattern.items())])
        if n > 0:
            packed.append((pattern, n))
            for s, a in pattern.items():
                left[s] -= a * n
    return packed + best_fit({s: n for s, n in left.items() if n}, length)


def places_of(packed: list[tuple[dict[int, int], int]]) -> dict[int, tuple]:
    """Per length: arrays (ranks from, first sequence, pieces a sequence, offset) of the patterns that hold it."""
    by: dict[int, list] = {}
    sequence = 0
    for pattern, times in packed:
        offset = 0
        for size in sorted(pattern, reverse=True):
            by.setdefault(size, []).append((pattern[size] * times, sequence, pattern[size], offset))
            offset += pattern[size] * size
        sequence += times
    out = {}
    for size, rows in by.items():
        n, first, each, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        out[size] = np.concatenate(([0], np.cumsum(n)[:-1])), first, each, offset
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, order: tuple = ()) -> DataFrame:
    """The pieces with their sequence_id and offset, gapless from 0 in each sequence; at_least: how many sequences any packing needs.

    order: (major, minor), columns of whole numbers that place each document; few share a major one.  Pieces of one
    length then go in that order, and sequences are numbered from 0 in the order of their longest piece.
    """
    rows = cut(pieces(docs, tokenizer_path, length, order))
    salt = F.col(ORDER[0]) if order else F.expr(f"cast(pmod(xxhash64(doc_id, piece, ids_crc32), {SALTS}) as int)")
    salted = rows.withColumn("salt", salt)
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packed, at_least = configuration(histogram, length) if histogram else ([], 0)
    place = places_of(packed)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy(*ORDER[1 : len(order)], "doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1).join(counts.hint("merge"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *ORDER[: len(order)], (F.col("before") + F.col("within")).alias("rank"))

    def run(batches):
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                start, first, each, base = place[int(size)]
                k = np.searchsorted(start, ranks[at], side="right") - 1
                nth = ranks[at] - start[k]
                sequence[at] = first[k] + nth // each[k]
                offset[at] = base[k] + nth % each[k] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset), pa.array(np.full(len(sizes), at_least))], [*batch.schema.names[:-1], "sequence_id", "offset", "at_least"])

    ends = "sequence_id long, offset long, at_least long"
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, {''.join(f'{n} long, ' for n in ORDER[: len(order)])}{ends}"
    packed_rows = ranked.mapInArrow(lean(run), schema)
    if not order:
        return packed_rows
    packed_rows = cut(packed_rows)
    first = packed_rows.filter("offset = 0").select(*ORDER, "piece", "sequence_id")
    again = numbered(first, "place", *ORDER, "piece", "sequence_id").select("sequence_id", "place")
    names = [n for n in packed_rows.columns if n not in ORDER]
    return packed_rows.join(again.hint("merge"), "sequence_id").withColumn("sequence_id", F.col("place")).select(*names)
