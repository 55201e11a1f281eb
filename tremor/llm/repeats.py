"""Repeated passages by a sparse suffix array.

Only suffixes at minimiser positions are kept: of any 25 consecutive runs of K = 26 words the
one with the smallest hash, so the 25 runs of a window of 50 words name one suffix, and equal
windows name it at the same offset.  Each suffix carries what its order needs: a hash of its
first K words, marks of the next 8 and 16 words, the same of the words before it (nearest
first), and a hash of all 24 words on either side.

1. The array: suffixes are range partitioned and sorted by their first K words, then by the
   words after them, then by those before, then by place.  Neighbours that agree in all of that
   belong together: each but the first repeats an earlier place in all its windows.
2. The first ones, where others begin with the same K words, are compared with their neighbours
   in the array for the length they share to the right, and sorted once more by the words
   before them for the length they share to the left.  No other suffix can share more than a
   neighbour does.
3. Within that reach matches are extended on the texts: the windows of 50 words that could
   match are compared as wholes, again as sorted neighbours.

A group that spans partitions needs no state of another task: in the array the first and the
last suffix of a partition count as having a neighbour that agrees in all, and of the windows
the first and last runs of each partition (two rows) meet once more.

With that every word of every repeated 50-word window is found, except the first
occurrence's; a window is equal by two hashes of 64 bits (its suffix's first K words, and all
its words).  Words are compared as they are, case included.  Null texts are empty; rows
without doc_id take no part; equal rows (same doc_id and text) count as one document; rows
that share a doc_id but not the text are kept apart by a checksum.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import lean, mix64, word_chunks
from .shared import IdFilter, cut, drop, free_name

MIN_WORDS = 50
GRAM = 26
REACH = MIN_WORDS - GRAM + 1
CONTEXT = MIN_WORDS - GRAM
#: Words that two suffixes can share beyond what their marks say: none equal, the first equal, both equal.
SHARED = np.array([7, 15, CONTEXT])
BLOCK = 1 << 20
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def checksum(text):
    return zlib.crc32(text) & 0x7FFFFFFF


def minimisers(grams, bounds):
    """(positions, first and last window) of the suffixes kept; windows are numbered by their first run.

    bounds: where the texts begin among the runs (and the last ends); a window lies within one
    text.  Each window keeps its smallest run, the leftmost of equals.
    """
    inside = np.zeros(len(grams) + 1, dtype=np.int8)
    long = bounds[1:] - bounds[:-1] >= MIN_WORDS
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - MIN_WORDS + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(windows):
        return windows, windows, windows
    chosen = []
    for at in range(0, len(grams) - REACH + 1, BLOCK):
        own = grams[at : at + BLOCK + REACH - 1]
        least = (own & ~_LOW) | np.arange(len(own), dtype=np.uint64)
        n, size = len(own) - REACH + 1, 1
        while size * 2 <= REACH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < REACH:
            least = np.minimum(least[:n], least[REACH - size :][:n])
        chosen.append(at + (least & _LOW).astype(np.int64))
    position, first, n = np.unique(np.concatenate(chosen)[windows], return_index=True, return_counts=True)
    return position, windows[first], windows[first + n - 1]


def marks(hashes, first, step, available):
    """Marks (16 bits) of the first 8 and 16 words from ``first``, and a hash of up to 24; texts' ends count."""
    total, out = np.zeros(len(first), dtype=np.uint64), []
    for i in range(CONTEXT):
        at = np.flatnonzero(available > i)
        total[at] += hashes[first[at] + step * i] * _U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
        if i in (7, 15, CONTEXT - 1):
            out.append(mix64(total + np.minimum(available, i + 1).astype(np.uint64)))
    return out[0] >> _U(48), out[1] >> _U(48), out[2]


SUFFIX = ["gram", "marks", "context", "doc", "at", "sum"]


def seeds(docs: DataFrame) -> DataFrame:
    """The kept suffixes.  at: position, then the least and greatest offset of its windows (5 bits each)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words in word_chunks(batch.column(1), fold=False):
                grams = words.windows(GRAM)
                p, first, last = minimisers(grams, words.bounds)
                if not len(p):
                    continue
                text = np.searchsorted(words.bounds, p, side="right") - 1
                a, b = words.bounds[text], words.bounds[text + 1]
                r8, r16, right = marks(words.hashes, p + GRAM, 1, np.minimum(b - p - GRAM, CONTEXT))
                l8, l16, left = marks(words.hashes, p - 1, -1, np.minimum(p - a, CONTEXT))
                key = r8 << _U(48) | r16 << _U(32) | l8 << _U(16) | l16
                sums = np.zeros(hi - lo, dtype=np.int64)
                for i in np.unique(text):
                    sums[i] = checksum(words.texts[i])
                at = (p - a) << 10 | (p - last) << 5 | (p - first)
                columns = [grams[p].view(np.int64), key.view(np.int64), mix64(right * _U(3) + left).view(np.int64), ids[lo + text], at, sums[text]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], SUFFIX)

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), ", ".join(f"{n} long" for n in SUFFIX))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (already cut, so that sampling them is cheap) in ranges of these columns, sorted within."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def _batch(names, columns):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in columns], names)


def _agreement(key, shift):
    """How many of the two marks below ``shift`` bits agree between neighbours."""
    key = key.view(np.uint64)
    one, two = key >> _U(shift - 16) & _U(0xFFFF), key >> _U(shift - 32) & _U(0xFFFF)
    first = one[1:] == one[:-1]
    return first.astype(np.int64) + (first & (two[1:] == two[:-1]))


def neighbours(array: DataFrame) -> DataFrame:
    """From the sorted suffixes: spans (gram null: doc, sum, a, b, fdoc, fa) of those that repeat an earlier place in all
    their windows; and the first of each kind (gram, marks, doc, at, sum, reach) where others begin alike."""
    names = ["gram", "marks", "doc", "at", "sum", "reach", "a", "b", "fdoc", "fa"]

    def out(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[x]) if x in columns else pa.nulls(n, pa.int64()) for x in names], names)

    def run(batches):
        carried, before = None, 2  # rows that go on: the last first one, the last row; and how far the first one agrees with the one before
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            fresh = 0 if carried is None else len(carried[0])
            if fresh:
                rows = [np.concatenate(x) for x in zip(carried, rows, strict=True)]
            gram, key, context, doc, at, total = rows
            alike = gram[1:] == gram[:-1]
            equal = alike & (key[1:] == key[:-1]) & (context[1:] == context[:-1])
            twice = equal & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (total[1:] == total[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~equal)))
            owner = first[np.cumsum(np.concatenate(([True], ~equal))) - 1]
            again = np.flatnonzero(equal & ~twice) + 1
            again = again[again >= fresh]
            if len(again):
                f = owner[again]
                low, high = at[again] >> 5 & 31, at[again] & 31
                yield out(len(again), doc=doc[again], sum=total[again], a=(at[again] >> 10) - high, b=(at[again] >> 10) - low + MIN_WORDS, fdoc=doc[f], fa=(at[f] >> 10) - high)
            agree = np.where(gram[first][1:] == gram[first][:-1], _agreement(key[first], 64), -1)
            agree = np.concatenate(([before], agree))
            done, best = first[:-1], np.maximum(agree[:-1], agree[1:])
            stay = best >= 0
            if stay.any():
                d = done[stay]
                yield out(len(d), gram=gram[d], marks=key[d], doc=doc[d], at=at[d], sum=total[d], reach=SHARED[best[stay]])
            before, end = agree[-1], first[-1]
            carried = [x[[end] if end == len(gram) - 1 else [end, -1]] for x in rows]
        if carried is not None:
            gram, key, _, doc, at, total = (x[:1] for x in carried)
            yield out(1, gram=gram, marks=key, doc=doc, at=at, sum=total, reach=SHARED[[2]])

    return array.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def within_reach(array: DataFrame) -> DataFrame:
    """From first ones sorted by the words before them: the windows (gram, doc, sum, first, last) that could match another's."""
    names = ["gram", "doc", "sum", "first", "last"]

    def run(batches):
        carried, before = None, 2

        def asked(gram, doc, at, total, right, agree):
            low = np.maximum(at >> 5 & 31, CONTEXT - right)
            high = np.minimum(at & 31, SHARED[agree])
            ok = (low <= high) & (agree >= 0)
            return _batch(names, [x[ok] for x in (gram, doc, total, (at >> 10) - high, (at >> 10) - low)])

        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            if carried is not None:
                rows = [np.concatenate(x) for x in zip(carried, rows, strict=True)]
            gram, key, doc, at, total, right = rows
            agree = np.concatenate(([before], np.where(gram[1:] == gram[:-1], _agreement(key, 32), -1)))
            if len(gram) > 1:
                yield asked(*(x[:-1] for x in (gram, doc, at, total, right)), np.maximum(agree[:-1], agree[1:]))
            before, carried = agree[-1], [x[-1:] for x in rows]
        if carried is not None:
            gram, _, doc, at, total, right = carried
            yield asked(gram, doc, at, total, right, np.array([2]))

    return array.select("gram", "marks", "doc", "at", "sum", "reach").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def windows_at(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The windows of 50 words asked for: gram, window (its hash), doc, a, sum.  Texts and lists meet by document."""
    names = ["gram", "window", "doc", "a", "sum"]
    lists = cut(asked.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.array("sum", "gram", "first", "last")).alias("asked")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    joined = IdFilter(lists.select("doc_id")).keep(rows, "doc_id").join(lists.hint("merge"), "doc_id").select("doc_id", "asked", "text")

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi, words in word_chunks(batch.column(2), fold=False):
                every, found = words.windows(MIN_WORDS).view(np.int64), []
                for i in range(hi - lo):
                    total = checksum(words.texts[i])
                    own = lists[lo + i].values.flatten().to_numpy().reshape(-1, 4)
                    own = own[own[:, 0] == total]  # else another text of the same doc_id
                    n = own[:, 3] - own[:, 2] + 1
                    a = np.repeat(own[:, 2] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append((np.repeat(own[:, 1], n), every[words.bounds[i] + a], np.full(len(a), ids[lo + i]), a, np.full(len(a), total)))
                if found:
                    yield _batch(names, [np.concatenate(x) for x in zip(*found, strict=True)])

    return joined.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Spans (doc, sum, a, b, fdoc, fa) of windows (already cut) that occur at an earlier place."""
    names = ["doc", "sum", "a", "fdoc", "fa", "gram", "window"]

    def run(batches):
        carried, border, first_run = None, [], True

        def last_run(c):
            return [c[2][0], c[4][0], c[3][0], None, None, c[0][0], c[1][0]]

        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            fresh = 0 if carried is None else len(carried[0])
            if fresh:
                rows = [np.concatenate(x) for x in zip(carried, rows, strict=True)]
            gram, window, doc, a, total = rows
            equal = (gram[1:] == gram[:-1]) & (window[1:] == window[:-1])
            twice = equal & (doc[1:] == doc[:-1]) & (a[1:] == a[:-1]) & (total[1:] == total[:-1])
            starts = np.concatenate(([True], ~equal))
            first = np.flatnonzero(starts)
            owner = first[np.cumsum(starts) - 1]
            again = np.flatnonzero(equal & ~twice) + 1
            again = again[again >= fresh]
            if len(again):
                f = owner[again]
                columns = [pa.array(x) for x in (doc[again], total[again], a[again], doc[f], a[f])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(again), pa.int64())] * 2], names)
            end = first[-1]
            now = [x[[end] if end == len(gram) - 1 else [end, -1]] for x in rows]
            if first_run and len(first) > 1:
                border.append(last_run([x[:1] for x in rows]))
                first_run = False
            carried = now
        if carried is not None:
            border.append(last_run(carried))
            yield pa.RecordBatch.from_arrays([pa.array([int(x) if x is not None else None for x in c], pa.int64()) for c in zip(*border, strict=True)], names)

    found = cut(in_order(windows, "gram", "window", "doc", "a", "sum").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names)))
    place = F.struct("doc", "a", "sum")
    # at most two rows a partition: runs that may go on in the next one
    borders = found.filter("window is not null").groupBy("gram", "window").agg(F.min(place).alias("f"), F.collect_set(place).alias("all"))
    borders = borders.select("f", F.explode("all").alias("x")).filter("x != f").selectExpr("x.doc as doc", "x.sum as sum", "x.a as a", "f.doc as fdoc", "f.a as fa")
    every = found.filter("window is null").select("doc", "sum", "a", "fdoc", "fa").union(borders)
    return every.selectExpr("doc", "sum", "a", f"a + {MIN_WORDS} as b", "fdoc", "fa")


def merged(spans: DataFrame) -> DataFrame:
    """Spans of one document that overlap or touch as one (doc, sum, a, b), with the earlier place (fdoc, fa) of its start."""
    names = ["doc", "sum", "a", "b", "fdoc", "fa"]

    def run(batches):
        last = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(6)]
            if last is not None:
                rows = [np.concatenate(([x], y)) for x, y in zip(last, rows, strict=True)]
            doc, total, a, b = rows[:4]
            other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])))
            # the greatest end so far within a document: ends are raised by a step for each document
            step = int(b.max()) + 1
            level = np.cumsum(other) * step
            reach = np.maximum.accumulate(b + level) - level
            new = np.flatnonzero(other | np.concatenate(([True], a[1:] > reach[:-1])))
            ends = np.concatenate((new[1:], [len(a)])) - 1
            out = [x[new] for x in rows]
            out[3] = reach[ends]
            last = [x[-1] for x in out]
            yield _batch(names, [x[:-1] for x in out])
        if last is not None:
            yield _batch(names, [[x] for x in last])

    dealt = spans.select(*names).repartition("doc", "sum").sortWithinPartitions(*names)
    return dealt.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def repeats(docs: DataFrame) -> DataFrame:
    """One row per maximal run of words of repeated 50-word windows: doc_id, first_word, end_word (exclusive),
    n_words, an earlier doc_id and word of its start, and a checksum of the text."""
    suffixes = cut(seeds(docs))
    found = cut(neighbours(in_order(suffixes, *SUFFIX)))
    drop(suffixes)
    backward = F.col("marks").bitwiseAND((1 << 32) - 1)
    array = found.filter("gram is not null").select("gram", "marks", "doc", "at", "sum", "reach").withColumn("left", backward)
    asked = within_reach(array.repartitionByRange("gram", "left", "doc", "at").sortWithinPartitions("gram", "left", "doc", "at", "sum"))
    windows = cut(windows_at(docs, asked))
    spans = found.filter("gram is null").select("doc", "sum", "a", "b", "fdoc", "fa").union(repeated_windows(windows))
    return merged(spans).selectExpr("doc as doc_id", "a as first_word", "b as end_word", "b - a as n_words", "fdoc as earlier_doc_id", "fa as earlier_word", "sum as checksum")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated run taken out of all places but the first; n_chars follows the text."""
    own = free_name(docs, "runs")
    found = cut(repeats(docs).select("doc_id", "checksum", "first_word", "end_word"))
    lists = found.groupBy("doc_id").agg(F.collect_list(F.array("checksum", "first_word", "end_word")).alias(own))
    names = docs.columns
    asked, known = IdFilter(found.select("doc_id")).split(docs, "doc_id")
    joined = asked.join(lists.hint("merge"), "doc_id", "left").select(*names, own)  # other texts stay where they are
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            runs = batch.column(len(names)).to_pylist()
            columns = list(batch.columns[: len(names)])
            if any(runs):
                texts = columns[text_at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i, own in enumerate(runs):
                    text = (texts[i] or "").encode("utf-8", "surrogatepass")
                    own = [(a, b) for s, a, b in own or [] if s == checksum(text)]
                    if own:
                        texts[i] = without(text, own).decode("utf-8", "surrogatepass")
                        if chars:
                            chars[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return known.unionByName(joined.mapInArrow(lean(run), docs.schema))


def without(text, runs):
    """The text less these runs of words, each up to the start of the next word that stays."""
    _, _, words = next(word_chunks([text], fold=False))
    keep, at = [], 0
    for a, b in sorted(runs):
        start = int(words.starts[a])
        end = int(words.starts[b]) if b < len(words.starts) else len(text)
        if start > at:
            keep.append(text[at:start])
        at = max(at, end)
    keep.append(text[at:])
    return b"".join(keep)
