"""Tables in the folder that driver and executors share: they end the lineage of what follows."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The session's checkpoint folder.  A session in one process may do without one and gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tremor-"))
    return context._jsc.sc().getCheckpointDir().get()


def files(spark, path: str):
    """(Hadoop path, its file system) of a path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    The files go when the session's file system is closed, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tremor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there, system = files(spark, path)
    system.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._tremor_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of ``df``, which ``written`` returned and nothing will read again."""
    there, system = files(df.sparkSession, df._tremor_path)
    system.delete(there, True)
