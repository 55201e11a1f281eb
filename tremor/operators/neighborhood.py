"""C8: the neighbourhood of a symbol as a diagram."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VIRTUAL, edge_line, escape_label, kind_rank
from ..plans.envelope import Answer
from ..storage import written
from .graph import CallGraph
from .queries import NODE_LIMIT, RADIUS

#: Text that other tools read (fixed values of the diagram format).
HEADER = "flowchart TD"
STYLES = [
    "classDef focus fill:#ffd54f,stroke:#333,stroke-width:2px;",
    "classDef boundary fill:#eeeeee,stroke:#999,stroke-dasharray:4 3;",
    "classDef trunc fill:#ffffff,stroke:#c62828,stroke-dasharray:2 2;",
]


def rings(graph: CallGraph, focus, depth: int) -> DataFrame:
    """(id, ring, fq_path, foreign): undirected rings; foreign nodes join one but are not expanded."""
    about = graph.symbols.select("id", "fq_path", F.col("characteristics.foreign").alias("foreign"))
    every = written(about.filter(F.col("id") == F.lit(focus)).withColumn("ring", F.lit(0)))
    steps = graph.edges.select(F.col("src").alias("at"), F.col("dst").alias("id")).union(graph.edges.select("dst", "src"))
    for ring in range(1, depth + 1):
        frontier = every.filter((F.col("ring") == ring - 1) & ~F.col("foreign")).select(F.col("id").alias("at"))
        new = steps.join(frontier, "at").select("id").distinct().join(every, "id", "left_anti")
        new = written(about.join(new, "id").withColumn("ring", F.lit(ring)))
        if new.isEmpty():
            break
        every = every.unionByName(new)
    return every


def numbered(nodes: DataFrame, node_limit: int) -> DataFrame:
    """The first nodes in order of ring and path, named n0, n1, ..."""
    first = nodes.orderBy("ring", "fq_path", "id").limit(node_limit)
    return first.withColumn("n", F.row_number().over(Window.orderBy("ring", "fq_path", "id")) - 1)  # at most node_limit rows


def drawn(graph: CallGraph, kept: DataFrame) -> DataFrame:
    """Edges out of kept nodes: to a kept node, to a boundary (named b<i> in order of first sight), or not drawn."""
    source = kept.select(F.col("id").alias("src"), F.concat(F.lit("n"), "n").alias("from_name"), F.col("fq_path").alias("from_path"))
    inside = kept.select(F.col("id").alias("dst"), F.concat(F.lit("n"), "n").alias("to_name"))
    names = graph.symbols.select(F.col("id").alias("dst"), F.col("fq_path").alias("to_path"))
    edges = graph.edges.join(F.broadcast(source), "src").join(F.broadcast(inside), "dst", "left").join(names, "dst", "left")
    edges = edges.filter("to_name is not null or dst_boundary").withColumn("rank", kind_rank(F.col("kind")))
    order = F.struct("from_path", "src", F.coalesce("to_path", F.lit("")).alias("to"), "dst", "rank")
    outside = edges.filter("to_name is null").groupBy("dst").agg(F.min(order).alias("seen"))
    outside = outside.withColumn("b", F.concat(F.lit("b"), F.row_number().over(Window.orderBy("seen")) - 1)).select("dst", "b")
    edges = edges.join(outside, "dst", "left").withColumn("order", order)
    return edges.select("order", "src", "dst", "kind", "from_name", F.coalesce("to_name", "b").alias("to_name"), F.col("b").isNotNull().alias("synthetic"), F.coalesce("to_path", F.lit("external")).alias("to_label"), "dst_boundary")


def neighborhood(graph: CallGraph, focus, depth: int = RADIUS, node_limit: int = NODE_LIMIT) -> Answer:
    """One row with the diagram's text, and the facts."""
    spark = graph.symbols.sparkSession
    nodes = rings(graph, focus, depth)
    if nodes.isEmpty():
        text = f"{HEADER}\n    %% focus symbol id {focus} not found in index\n"
        facts = spark.sql("select 0L total, false truncated, false over_approximated, 0L implementor_count, false boundary_applies")
        return Answer({"diagram": spark.range(1).select(F.lit(text).alias("text"))}, facts)
    kept = written(numbered(nodes, node_limit))
    edges = written(drawn(graph, kept))
    total = nodes.count()
    style = F.when(F.col("ring") == 0, ":::focus").when(F.col("foreign"), ":::boundary").otherwise("")
    place = F.struct("order.*")
    blank = edges.limit(0).select(place.alias("p")).schema["p"].dataType
    none = F.lit(None).cast(blank)
    parts = [
        kept.select(F.struct(F.lit(1).alias("part"), F.col("n").cast("long").alias("n"), none.alias("place"), F.concat(F.lit("n"), "n", F.lit('["'), escape_label(F.col("fq_path")), F.lit('"]'), style).alias("text")).alias("line")),
        edges.filter("synthetic").select("to_name", "to_label").distinct().select(F.struct(F.lit(2).alias("part"), F.substring("to_name", 2, 20).cast("long").alias("n"), none.alias("place"), F.concat("to_name", F.lit('["'), escape_label(F.col("to_label")), F.lit('"]:::boundary')).alias("text")).alias("line")),
        edges.select(F.struct(F.lit(4).alias("part"), F.lit(0).cast("long").alias("n"), place.alias("place"), edge_line(F.col("from_name"), F.col("to_name"), F.col("dst_boundary"), F.col("kind")).alias("text")).alias("line")),
    ]
    hidden = total - min(total, node_limit)
    fixed = [(5, i, s) for i, s in enumerate(STYLES)] + ([(3, 0, f'trunc_note["+{hidden} more not shown (total {total})"]:::trunc')] if hidden else [])
    for part, i, text in fixed:
        parts.append(spark.range(1).select(F.struct(F.lit(part).alias("part"), F.lit(i).cast("long").alias("n"), none.alias("place"), F.lit(text).alias("text")).alias("line")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.union(p)
    body = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: F.concat(F.lit("    "), x["text"], F.lit("\n"))), "")
    text = lines.agg(F.concat(F.lit(f"{HEADER}\n"), body).alias("text"))
    virtual = F.col("kind") == VIRTUAL
    shown = edges.agg(F.coalesce(F.bool_or(virtual), F.lit(False)).alias("over_approximated"), F.coalesce(F.bool_or("dst_boundary"), F.lit(False)).alias("boundary_applies"))
    # targets of dynamic calls of kept nodes count even where the edge is not drawn
    targets = graph.edges.filter(virtual).join(kept.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count_distinct("dst").alias("implementor_count"))
    facts = shown.join(F.broadcast(targets), F.lit(True)).select(F.lit(total).cast("long").alias("total"), F.lit(hidden > 0).alias("truncated"), "over_approximated", "implementor_count", "boundary_applies")
    return Answer({"diagram": text}, facts)
