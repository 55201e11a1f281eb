"""Source trees: which files count, and their hashes, read on the executors."""

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import fnv1a64_bytes

LOCK = "Cargo.lock"


def source_files(root: str) -> list[str]:
    """Regular files with extension rs below ``root``, as sorted paths with '/'; not in target or dotted folders, no links."""
    out = []
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d != "target" and not d.startswith(".") and not os.path.islink(os.path.join(folder, d))]
        for name in names:
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1] == ".rs" and os.path.isfile(path) and not os.path.islink(path):
                out.append(os.path.relpath(path, root).replace(os.sep, "/"))
    return sorted(out)


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of the source files; every byte counts, times do not."""
    paths = [(p,) for p in source_files(root)]

    def run(frames):
        for frame in frames:
            hashes = []
            for p in frame["path"]:
                with open(os.path.join(root, p), "rb") as f:
                    hashes.append(fnv1a64_bytes(f.read()))
            yield pd.DataFrame({"path": frame["path"], "hash": hashes})

    return spark.createDataFrame(paths, "path string").mapInPandas(run, "path string, hash string")


def lock_hash(root: str) -> str:
    """Hash of the lock file; '' if there is none, other errors are raised."""
    try:
        with open(os.path.join(root, LOCK), "rb") as f:
            return fnv1a64_bytes(f.read())
    except FileNotFoundError:
        return ""
