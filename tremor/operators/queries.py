"""The graph queries C1 to C7.  Each gives full totals first and limits afterwards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_name, kind_rank
from ..plans.envelope import Answer
from ..storage import written
from .graph import BACKWARD, FORWARD, CallGraph, flags

#: Defaults of the service.
LIMIT, MAX_DEPTH, MAX_PATHS, RADIUS, NODE_LIMIT = 200, 8, 64, 2, 60


def answer(lists: dict[str, DataFrame], limit: int, scanned: DataFrame | None = None, held: tuple = ()) -> Answer:
    """Sorts by (fq_path, id), limits each list, and counts before the limit."""
    names = [df.select(F.lit(name).alias("list")) for name, df in lists.items()]
    every = names[0]
    for n in names[1:]:
        every = every.union(n)
    cut_off = F.lit(False)
    for name in lists:
        cut_off = cut_off | (F.count_if(F.col("list") == name) > limit)
    facts = every.agg(F.count("*").alias("total"), cut_off.alias("truncated"))
    if scanned is None:
        facts = facts.select("*", F.lit(False).alias("over_approximated"), F.lit(0).cast("long").alias("implementor_count"), F.lit(False).alias("boundary_applies"))
    else:
        facts = facts.join(F.broadcast(flags(scanned)), F.lit(True))  # one row each
    return Answer({name: df.orderBy("fq_path", "id").limit(limit) for name, df in lists.items()}, facts, held)


def resolve(graph: CallGraph, query: str, limit: int = LIMIT) -> Answer:
    """C1: symbols whose path holds the query, whatever the case."""
    return answer({"symbols": graph.symbols.filter(contains_name(F.col("fq_path"), query))}, limit)


def _callers(graph, symbol):
    return graph.edges.filter(F.col("dst") == F.lit(symbol))


def direct_calls(graph: CallGraph, symbol, limit: int = LIMIT) -> Answer:
    """C2: one hop each way; a neighbour comes once per edge."""
    into, out = _callers(graph, symbol), graph.edges.filter(F.col("src") == F.lit(symbol))
    lists = {"callers": graph.named(into.select(F.col("src").alias("id"))), "callees": graph.named(out.select(F.col("dst").alias("id")))}
    return answer(lists, limit, into.unionByName(out))


def _walk(graph, symbol, direction):
    reached = graph.closure(symbol, direction).persist()
    return reached, graph.scanned(symbol, reached, direction)


def reachability(graph: CallGraph, symbol, direction: str = FORWARD, limit: int = LIMIT) -> Answer:
    """C3: everything that a walk in one direction reaches."""
    reached, scanned = _walk(graph, symbol, direction)
    return answer({"symbols": graph.named(reached)}, limit, scanned, (reached,))


def affected_tests(graph: CallGraph, symbol, limit: int = LIMIT) -> Answer:
    """C5: tests that reach the symbol."""
    reached, scanned = _walk(graph, symbol, BACKWARD)
    return answer({"tests": graph.named(reached).filter("characteristics.test")}, limit, scanned, (reached,))


def reachable_unsafe(graph: CallGraph, symbol, limit: int = LIMIT) -> Answer:
    """C6: symbols that use unsafe code and are reached from the symbol."""
    reached, scanned = _walk(graph, symbol, FORWARD)
    return answer({"symbols": graph.named(reached).filter("characteristics.uses_unsafe")}, limit, scanned, (reached,))


def impact(graph: CallGraph, symbol, limit: int = LIMIT) -> Answer:
    """C7: direct callers and affected tests; a test that calls directly counts in both.

    The edges into the symbol are among those the walk scans, so its flags cover both lists.
    """
    reached, scanned = _walk(graph, symbol, BACKWARD)
    lists = {"direct_callers": graph.named(_callers(graph, symbol).select(F.col("src").alias("id"))), "affected_tests": graph.named(reached).filter("characteristics.test")}
    return answer(lists, limit, scanned, (reached,))


def call_paths(graph: CallGraph, source, target, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> Answer:
    """C4: simple paths of at most ``max_depth`` edges, in order of their names.

    Paths grow level by level; once more than ``max_paths`` have arrived, whatever sorts after
    the first one too many is dropped.  Foreign symbols are crossed, unknown ones are not.
    The total is the number returned.  Flags come from every edge looked at, up to the cap.
    """
    spark = graph.symbols.sparkSession
    kind = graph.symbols.schema["id"].dataType
    names = graph.symbols.select(F.col("id").alias("dst"), "fq_path")
    step = F.struct(F.coalesce("fq_path", F.lit("")).alias("f"), F.col("dst").alias("i"), kind_rank(F.col("kind")).alias("k"))
    steps = graph.edges.join(names, "dst", "left").select(F.col("src").alias("at"), "dst", "kind", "dst_boundary", "dst_absent", step.alias("step"))
    steps = steps.persist()
    start = F.lit(source).cast(kind)
    key_type = f"array<{steps.schema['step'].dataType.simpleString()}>"
    open_paths = spark.range(1).select(F.array(start).alias("path"), F.from_json(F.lit("[]"), key_type).alias("key"), start.alias("last"))
    arrived, looked_at, bound = None, [], None
    for _ in range(max_depth):
        tried = open_paths.join(steps, open_paths["last"] == steps["at"]).select("path", F.concat("key", F.array("step")).alias("key"), "dst", "kind", "dst_boundary", "dst_absent")
        tried = written(tried if bound is None else tried.filter(F.col("key") <= _literal(bound, key_type)))
        looked_at.append(tried.select("key", "dst", "kind", "dst_boundary"))
        onward = tried.filter(~F.col("dst_absent") & ~F.array_contains("path", F.col("dst")))
        there = F.col("dst") == F.lit(target)
        new = onward.filter(there).select(F.concat("path", F.array("dst")).alias("path"), "key")
        arrived = new if arrived is None else arrived.union(new)
        first = arrived.orderBy("key").limit(max_paths + 1).select(F.to_json("key").alias("key"), F.row_number().over(Window.orderBy("key")).alias("n")).filter(F.col("n") > max_paths).first()
        bound = first["key"] if first else None
        open_paths = onward.filter(~there).select(F.concat("path", F.array("dst")).alias("path"), "key", F.col("dst").alias("last"))
        if bound is not None:
            open_paths = open_paths.filter(F.col("key") <= _literal(bound, key_type))
        if open_paths.isEmpty():
            break
    none = spark.range(0).select(F.array(start).alias("path"), F.from_json(F.lit("[]"), key_type).alias("key"))
    arrived = none if arrived is None else arrived
    cut_off = bound is not None or not open_paths.join(steps, (open_paths["last"] == steps["at"]) & (steps["dst"] != steps["at"])).isEmpty()
    scanned = looked_at[0] if looked_at else steps.select(F.array("step").alias("key"), "dst", "kind", "dst_boundary").limit(0)
    for t in looked_at[1:]:
        scanned = scanned.union(t)
    if bound is not None:
        scanned = scanned.filter(F.col("key") <= _literal(bound, key_type))
    rows = arrived.orderBy("key").limit(max_paths)
    begin = graph.symbols.filter(F.col("id") == start).select("fq_path")
    rows = rows.join(F.broadcast(begin), F.lit(True)).select(F.concat(F.array("fq_path"), F.transform("key", lambda s: s["f"])).alias("names"), "path")
    facts = rows.agg(F.count("*").alias("total"), F.lit(cut_off).alias("truncated")).join(F.broadcast(flags(scanned)), F.lit(True))
    return Answer({"paths": rows}, facts, (steps,))


def _literal(key_json, key_type):
    return F.from_json(F.lit(key_json), key_type)
