import math
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import kernel, mixing

SF = "/root/testdata/sf0.001"


def test_equal_weights_have_windows_of_their_own(spark):
    """Releases and deadlines come from the weights, and earliest deadline first among the released gives the slots."""
    r = random.Random(3)
    n = {f"s{i}": r.choice([1, 2, 5, 9]) for i in range(12)}
    blocks = spark.createDataFrame(list(n.items()), "stream string, n_blocks long")
    windows = {b: (release, due) for b, release, due in mixing.equal_windows(blocks).collect()}
    base = first = 0
    for end in sorted(set(n.values())):
        m = sum(x >= end for x in n.values())
        for k in range(end - first):
            assert windows.pop(first + k) == (base + math.floor(k * m), base + math.ceil((k + 1) * m))
        base, first = base + m * (end - first), end
    assert not windows
    slots = {r["slot"]: r for r in mixing.equal_slots(blocks).collect()}
    left = [(x["deadline"], x["stream"], x["release"]) for x in slots.values()]
    assert sorted(slots) == list(range(sum(n.values())))
    for t in sorted(slots):
        earliest = min(x for x in left if x[2] <= t)
        assert earliest[:2] == (slots[t]["deadline"], slots[t]["stream"]) and t < earliest[0]
        left.remove(earliest)


def test_sequences_follow_the_mix(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = {}
    for name, mixed in (("mix", stages["mixing to target weights"](spark, docs, SF)), ("back", docs.repartitionByRange(3, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")))):
        mixed.write.parquet(str(tmp_path / name))
        place = {r["doc_id"]: i for i, r in enumerate(mixed.select("doc_id").collect())}
        rows = stages["best-fit packing"](spark, spark.read.parquet(str(tmp_path / name)), SF).collect()
        first = sorted((r["sequence_id"], place[r["doc_id"]]) for r in rows if r["offset"] == 0)
        assert [s for s, _ in first] == list(range(len(first))) and [p for _, p in first] == sorted(p for _, p in first)
        held = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == held.get(r["sequence_id"], 0)
            held[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(held.values()) <= 2048
        packed[name] = {(r["doc_id"], r["piece"]): r["sequence_id"] for r in rows}
    assert packed["mix"].keys() == packed["back"].keys() and packed["mix"] != packed["back"]


def test_lean_functions_give_the_same():
    assert list(kernel.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4]
