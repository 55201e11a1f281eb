"""Helpers that several operators use."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, shared_folder
from ..storage import written as cut

__all__ = ["IdFilter", "cut", "documents", "drop", "free_name", "lanes", "numbered", "partitions", "shared_folder", "small_side"]

#: A side of at most so many bytes (rows times 8 bytes a column, all columns being numbers) is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 1 << 18


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lanes(spark) -> list[int]:
    """One integer (int) for each shuffle partition that Spark's hash deals there, so that keys can be dealt out evenly."""
    n = partitions(spark)
    found = spark.range(0, 20 * n + 200).select(F.col("id").cast("int").alias("v"), F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p"))
    by = {r["p"]: r["v"] for r in found.groupBy("p").agg(F.min("v").alias("v")).collect()}
    return [by.get(p, p) for p in range(n)]


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (already cut, columns of plain numbers) marked for broadcast if it is small by count, else for a merge join.

    Spark's own choice, by the size of compressed files, is never left to it.
    """
    rows = BROADCAST_BYTES // (8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


#: An id filter has 2**16 words of 64 bits, whatever the number of ids: half a megabyte of bits, all words being there.
FILTER_WORDS = 16


class IdFilter:
    """Tells rows whose id could be among ``ids`` (one column of longs) from those whose id is certainly not.

    A Bloom filter of one hash and a fixed size, as a table of its words, which is broadcast.  It
    spares rows a shuffle to a join that would drop them.  With very many ids it lets more
    through, never fewer.  Null is certainly not among them.
    """

    def __init__(self, ids: DataFrame):
        (name,) = ids.columns
        word, bit = self._place(F.col(name))
        rows = ids.filter(F.col(name).isNotNull()).select(word.alias("word"), bit.alias("bit"))
        used = rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        every = ids.sparkSession.range(1 << FILTER_WORDS).select(F.col("id").alias("word"))
        self.words = cut(every.join(used.hint("merge"), "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits")))

    @staticmethod
    def _place(id_):
        h = F.xxhash64(id_.cast("long"))
        return h.bitwiseAND((1 << FILTER_WORDS) - 1), F.shiftrightunsigned(h, FILTER_WORDS).bitwiseAND(63).cast("int")

    def split(self, df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose ``name`` could be among the ids, all others), with the columns of ``df``."""
        word, bits = free_name(df, "word"), free_name(df, "bits")
        place, bit = self._place(F.col(name))
        table = F.broadcast(self.words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        joined = df.withColumn(word, place).join(table, word)
        held = F.col(name).isNotNull() & (F.call_function("shiftright", F.col(bits), bit).bitwiseAND(1) == 1)
        return joined.filter(held).select(*df.columns), joined.filter(~held).select(*df.columns)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.split(df, name)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` (already cut) with ``name``, their number from 0 in ``order``, which no two of them share."""
    part, at = free_name(rows, "part"), free_name(rows, "at")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(sorted_.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(at)))
    sizes = found.groupBy(part).agg(F.count("*").alias("n"))  # one row a partition
    base = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(F.broadcast(base), part).select(*rows.columns, (F.col("base") + F.col(at)).alias(name))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
