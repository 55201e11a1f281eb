"""Fragments (one JSON file each), the merged index and its manifest.

JSON is the exchange format.  Tables of any size live in Parquet, which ``save_tables`` and
``load_tables`` write and read without gathering anything.
"""

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

FOLDER = ".tremor"


class IndexError_(Exception):
    """A missing, unreadable or incompatible index; the message names the file."""


def read_fragments(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """symbols, edges, dyn_calls and impl_methods of all *.json in a folder, each with its ``fragment`` (file name)."""
    files = spark.read.schema(schemas.FRAGMENT).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    files = files.withColumn("fragment", F.element_at(F.split(F.input_file_name(), "/"), -1))

    def table(name):
        return files.select("fragment", F.explode(name).alias("x")).select("fragment", "x.*")  # absent counts as empty

    edges = table("edges").withColumnsRenamed({"from": "src", "to": "dst"})
    return {"symbols": table("symbols"), "edges": edges, "dyn_calls": table("dyn_calls"), "impl_methods": table("impl_methods")}


def write_fragment(folder: str, unit: str, fragment: dict) -> str:
    """One file per compilation unit, under a name that parallel writers never share."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{unit}-{os.getpid()}-{uuid.uuid4().hex}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(fragment, f, separators=(",", ":"))
    return path


def arg_value(args: Column, flag: str) -> Column:
    """The value of a flag in a compiler's arguments, as ``flag value`` or ``flag=value``; the first that has one."""
    both = F.transform(args, lambda a, i: F.when(a == flag, F.get(args, i + 1)).when(a.startswith(f"{flag}="), F.substr(a, F.lit(len(flag) + 2))))
    return F.get(F.filter(both, lambda v: v.isNotNull()), F.lit(0))


def compile_units(calls: DataFrame) -> DataFrame:
    """Calls of the compiler (primary, args) that yield a fragment, with crate_name and crate_type read from their arguments."""
    args = F.col("args")
    macro = F.exists(args, lambda a: a == "--crate-type=proc-macro") | F.exists(F.transform(args, lambda a, i: (a == "--crate-type") & F.coalesce(F.get(args, i + 1) == "proc-macro", F.lit(False))), lambda x: x)
    kind = F.when(macro, "proc-macro").otherwise(arg_value(args, "--crate-type"))
    units = calls.withColumns({"crate_name": arg_value(args, "--crate-name"), "crate_type": kind, "has_source": F.exists(args, lambda a: a.endswith(".rs"))})
    return wants_fragment(units)


def wants_fragment(units: DataFrame) -> DataFrame:
    """Of compile units (primary, crate_name, crate_type, has_source) those that yield a fragment."""
    return units.filter(F.col("primary") & F.col("crate_name").isNotNull() & ~F.col("crate_name").startswith("build_script") & (F.coalesce("crate_type", F.lit("")) != "proc-macro") & F.col("has_source"))


def write_index(root: str, symbols: DataFrame, edges: DataFrame, manifest: dict) -> None:
    """Index as compact JSON sorted by path and by edge, and the manifest; equal inputs give equal bytes."""
    folder = os.path.join(root, FOLDER)
    os.makedirs(folder, exist_ok=True)
    rows = lambda df, sort: [r.asDict(recursive=True) for r in df.orderBy(*sort).toLocalIterator()]
    plain = lambda x: int(x) if hasattr(x, "as_tuple") else x
    nodes = [{k: plain(v) for k, v in r.items()} for r in rows(symbols.select("id", "fq_path", "crate_name", "span", "characteristics"), ["fq_path", "id"])]
    arrows = rows(edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind"), ["from", "to", "kind"])
    index = {"schema_version": schemas.VERSION, "symbols": nodes, "edges": [{k: plain(v) for k, v in r.items()} for r in arrows]}
    with open(os.path.join(folder, "index.bin"), "w", encoding="utf-8") as f:
        json.dump(index, f, separators=(",", ":"), ensure_ascii=False)
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest | {"file_hashes": dict(sorted(manifest["file_hashes"].items()))}, f, indent=2, ensure_ascii=False)


def _one(spark, path, schema):
    if not os.path.exists(path):
        raise IndexError_(f"{path}: no such file; build the index first")
    try:
        row = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
        version = row.select("schema_version").first()
    except Exception as e:
        raise IndexError_(f"{path}: cannot be read: {e}") from e
    if version is None or version[0] is None:
        raise IndexError_(f"{path}: cannot be read")
    return row, version[0]


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, manifest row); only the index's version is checked."""
    folder = os.path.join(root, FOLDER)
    index, version = _one(spark, os.path.join(folder, "index.bin"), schemas.INDEX)
    if version != schemas.VERSION:
        raise IndexError_(f"{folder}/index.bin: schema version {version}, expected {schemas.VERSION}")
    manifest, _ = _one(spark, os.path.join(folder, "manifest.json"), schemas.MANIFEST)
    edges = index.select(F.inline("edges")).withColumnsRenamed({"from": "src", "to": "dst"})
    return index.select(F.inline("symbols")), edges, manifest


def save_tables(symbols: DataFrame, edges: DataFrame, folder: str) -> None:
    symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/symbols"), spark.read.parquet(f"{folder}/edges")


def workspace_root(arguments: list[str], variable: str = "TREMOR_WORKSPACE") -> str:
    """The first argument, else a non-empty environment variable, else the current folder."""
    return arguments[0] if arguments else os.environ.get(variable) or "."
