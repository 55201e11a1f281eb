"""Small graphs for tests: ids are 1, 2, ... in order of names; 'a>b' is Static, 'a~b' Virtual."""

from tremor.operators.graph import CallGraph
from tremor.sources.schemas import FLAGS

SYMBOL = "id long, fq_path string, crate_name string, span struct<file:string,line_start:bigint,line_end:bigint>, characteristics struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ">"


def graph(spark, names, edges="", absent=(), one_task_edges=10_000, **marks):
    ids = {n: i for i, n in enumerate([*names, *absent], 1)}
    row = lambda n: (ids[n], n, n.split("::")[0], ("src/lib.rs", 1, 2), tuple(n in marks.get(f, ()) or f == "public" for f in FLAGS))
    symbols = spark.createDataFrame([row(n) for n in names], SYMBOL)
    pairs = []
    for e in edges.split():
        mark = next(c for c in e if c in ">~")
        a, b = e.split(mark, 1)
        pairs.append((ids[a], ids[b], "Static" if mark == ">" else "Virtual"))
    return CallGraph(symbols, spark.createDataFrame(pairs, "src long, dst long, kind string"), one_task_edges), ids


def paths(answer, name=None):
    e = answer.envelope()
    rows = e.data if name is None else e.data[name]
    return [r["fq_path"] for r in rows]
