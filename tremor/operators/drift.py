"""Whether sources have changed since the index was built."""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rfc3339
from ..sources import tree
from ..sources.schemas import VERSION


def diverged(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Paths (path, hash) that were changed, added or removed."""
    r, c = recorded.select("path", F.col("hash").alias("was")), current.select("path", F.col("hash").alias("now"))
    return r.join(c, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select("path")


def fingerprint(spark: SparkSession, root: str, toolchain: str) -> dict:
    """The manifest of a workspace as it is now."""
    hashes = {r["path"]: r["hash"] for r in tree.file_hashes(spark, root).toLocalIterator()}
    at = spark.range(1).select(rfc3339(F.lit(int(time.time())))).first()[0]
    return {"schema_version": VERSION, "toolchain": toolchain, "file_hashes": hashes, "cargo_lock_hash": tree.lock_hash(root), "indexed_at": at}


def diverged_files(spark: SparkSession, manifest: DataFrame, root: str) -> list[str]:
    """Sorted paths that differ from the manifest row, the lock file included; the toolchain is not compared."""
    recorded = manifest.select(F.explode("file_hashes").alias("path", "hash"))
    found = [r["path"] for r in diverged(recorded, tree.file_hashes(spark, root)).toLocalIterator()]
    if manifest.first()["cargo_lock_hash"] != tree.lock_hash(root):
        found.append(tree.LOCK)
    return sorted(set(found))
