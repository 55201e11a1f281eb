"""A Structured Streaming job that takes in new fragments and rewrites the merged tables.

An addition of this library: the raw facts are appended once per fragment (exactly once, by
batch id), and each batch that brings any replaces the merged tables from all facts.
"""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge_fragments
from ..sources import schemas
from ..sources.index import save_tables

PARTS = ["symbols", "edges", "dyn_calls", "impl_methods"]


def refresh(spark: SparkSession, fragments: str, tables: str, checkpoint: str) -> None:
    """Takes in every fragment not seen before and returns when the tables are current."""

    def take_in(batch, batch_id):
        batch = batch.withColumn("fragment", F.element_at(F.split(F.col("file"), "/"), -1)).persist()
        for part in PARTS:
            rows = batch.select("fragment", F.explode(part).alias("x")).select("fragment", "x.*")
            rows.write.mode("overwrite").parquet(f"{tables}/facts/{part}/batch={batch_id}")
        facts = {part: spark.read.parquet(f"{tables}/facts/{part}").drop("batch") for part in PARTS}
        facts["edges"] = facts["edges"].withColumnsRenamed({"from": "src", "to": "dst"})
        symbols, edges = merge_fragments(facts)
        save_tables(symbols, edges, f"{tables}/merged")
        batch.unpersist()

    stream = spark.readStream.schema(schemas.FRAGMENT).option("multiLine", True).option("pathGlobFilter", "*.json").json(fragments)
    stream = stream.withColumn("file", F.input_file_name())
    query = stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
