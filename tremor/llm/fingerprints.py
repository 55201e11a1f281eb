"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of
any sizes merge by union and estimate containment as well as likeness.  A fingerprint is
text: the scale, the number of shingles, a digest of the whole set, then the kept hashes
ascending.  Equal texts have equal fingerprints; digests that agree mean likeness 1, whatever
was kept, and where neither kept any hash (some texts of a few words) others have likeness 0.
A merged fingerprint is one too, without number and digest, which its parts do not tell;
fingerprints of two scales are compared and merged at the coarser one.

For the next document in order of doc_id, rows are dealt to ranges of doc_id and the first
row of each range is also sent to the range before it, so no task needs another's output.
Ranges hold about the same numbers of rows and go to partitions in even lots.  Null ids come
last, by a hash of their text and so over many ranges; rows that share an id are ordered by
text, null texts are empty, and the document after the last is the first.  Repeated rows have
a row each, an empty table gives none; other columns, of any name, are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, chunks, set_digest
from .shared import lanes, partitions

SCALE = 4


def sketch_of(s, scale=SCALE):
    """The hashes of an ascending set below 2**64 / scale."""
    return s[: np.searchsorted(s, np.uint64((1 << 64) // scale - 1), side="right")]


def _text(scale, n, digest, kept):
    return f"{scale:x}.{n}.{digest}:{kept.astype('>u8').tobytes().hex()}"


def fingerprint_text(s, kept, scale=SCALE):
    return _text(scale, f"{len(s):x}", f"{set_digest(s) & (1 << 64) - 1:016x}", kept)


def parse(fingerprint):
    """(scale, number of shingles, digest, kept hashes) of a fingerprint; number and digest are None where it was merged."""
    head, _, body = fingerprint.partition(":")
    scale, n, digest = head.split(".")
    return int(scale, 16), int(n, 16) if n else None, digest or None, np.frombuffer(bytes.fromhex(body), dtype=">u8").astype(np.uint64)


def _both(one, two):
    """Scale, kept hashes of both at that scale, and whether the digests agree."""
    a, b = parse(one), parse(two)
    scale = max(a[0], b[0])
    return scale, sketch_of(a[3], scale), sketch_of(b[3], scale), a[2] is not None and a[1:3] == b[1:3]


def shared_of(a, b):
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a, b, same):
    """Estimated Jaccard similarity of two sketches; ``same``: whether the digests agree."""
    if same:
        return 1.0
    both = shared_of(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def containment(a, b, same=False):
    """Estimated share of a's shingles that b has too; of an empty sketch 0, unless the digests agree."""
    return 1.0 if same else shared_of(a, b) / len(a) if len(a) else 0.0


def merge(one, two):
    """The fingerprint of two fingerprints' united sets."""
    if one == two:
        return one
    scale, a, b, _ = _both(one, two)
    return _text(scale, "", "", np.union1d(a, b))


def compare(one, two):
    """(likeness, containment of one in two) of any two fingerprints."""
    _, a, b, same = _both(one, two)
    return likeness(a, b, same), containment(a, b, same)


def _dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, dest, guest, lane: each row in its range, the first of each range also as guest of the one before."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    n = 4 * partitions(spark)
    shares = [i / n for i in range(1, n)]
    found = rows.agg(*[F.percentile_approx(F.when(F.col("unnamed") == x, F.col("key")), shares, 20 * n) for x in (False, True)]).first()
    cuts = [np.unique(np.array(c or [], dtype=np.int64)) for c in found]

    def range_at(keys, unnamed):
        k = keys.to_numpy(zero_copy_only=False)
        return np.where(unnamed.to_numpy(zero_copy_only=False), len(cuts[0]) + 1 + np.searchsorted(cuts[1], k, side="left"), np.searchsorted(cuts[0], k, side="left"))

    @F.arrow_udf("long")
    def range_of(keys: pa.Array, unnamed: pa.Array) -> pa.Array:
        return pa.array(range_at(keys, unnamed))

    ranges = rows.select("key", "unnamed").withColumn("dest", range_of("key", "unnamed")).groupBy("dest").agg(F.min("key").alias("key"))
    first = sorted((r["dest"], r["key"]) for r in ranges.collect())  # at most 2 n rows
    before = {dest: first[i - 1][0] for i, (dest, _) in enumerate(first)}
    starts = dict(first)

    @F.arrow_udf("array<long>")
    def places(keys: pa.Array, unnamed: pa.Array) -> pa.Array:
        return pa.array([[d, -1 - before[d]] if starts[d] == x else [d] for d, x in zip(range_at(keys, unnamed).tolist(), keys.to_pylist(), strict=True)], pa.list_(pa.int64()))

    dealt = rows.withColumn("to", F.explode(places("key", "unnamed")))
    dealt = dealt.withColumn("dest", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to"))).withColumn("guest", F.col("to") < 0)
    lane_of, number = lanes(spark), {dest: i for i, (dest, _) in enumerate(first)}
    lane = {dest: lane_of[i * len(lane_of) // len(number)] for dest, i in number.items()}

    @F.arrow_udf("int")
    def lane_at(dests: pa.Array) -> pa.Array:
        return pa.array([lane[d] for d in dests.to_pylist()], pa.int32())

    return dealt.withColumn("lane", lane_at("dest"))


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per row: n_chars, the edited text's digest, both fingerprints, and their likenesses.

    The edited text is the text whose last floor(n_chars / 2) code points give way to the
    first as many (or all) of the next document.
    """

    def work(rows):
        """Rows (dest, guest, doc_id, text) in order, the last only as a neighbour."""
        texts = [r[3] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in enumerate(texts[:-1])]
        every = [t.encode("utf-8", "surrogatepass") for t in texts + edited]
        sets = []
        for lo, hi in chunks([len(t) for t in every]):
            sets += Words(every[lo:hi]).shingle_sets()
        kept = [sketch_of(s, scale) for s in sets]
        digests = [set_digest(s) for s in sets]
        out = []
        for i, (_, guest, doc_id, text) in enumerate(rows[:-1]):
            if guest:
                continue
            j = len(rows) + i
            ways = []
            for k in (j, i + 1):
                same = digests[i] == digests[k] and len(sets[i]) == len(sets[k])
                ways.append((likeness(kept[i], kept[k], same), containment(kept[i], kept[k], same)))
            out.append((doc_id, len(text), hashlib.sha256(every[j]).hexdigest(), fingerprint_text(sets[i], kept[i], scale), fingerprint_text(sets[j], kept[j], scale), ways[0][0], ways[1][0], ways[0][1], ways[1][1]))
        return out

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append((*row[:3], row[3] or ""))
                size += len(rows[-1][3])
                if size > 1 << 20 and len(rows) > 1:
                    yield batch_of(work(rows))
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield batch_of(work(rows))

    dealt = _dealt(docs).repartition("lane").sortWithinPartitions("dest", "guest", "key", "text")
    return dealt.select("dest", "guest", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double")
