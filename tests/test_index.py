import json
import os

import pytest
from pyspark.sql import functions as F

from tremor.functions.hashing import fnv1a64, fnv1a64_bytes, fnv1a64_hex
from tremor.functions.text import last_part, rfc3339
from tremor.operators import drift, merge
from tremor.plans.envelope import Envelope
from tremor.plans.service import Service
from tremor.sources import index, tree
from tremor.streaming.refresh import refresh

FLAGS = ["test", "public", "is_async", "generic", "foreign", "uses_unsafe"]


def fid(path):
    return int(fnv1a64_bytes(path.encode()), 16)


def symbol(path, **marks):
    number = marks.pop("id", None) or fid(path)
    return {"id": number, "fq_path": path, "crate_name": path.split("::")[0], "span": {"file": "src/lib.rs", "line_start": 1, "line_end": 2}, "characteristics": {f: marks.get(f, f == "public") for f in FLAGS}}


def edge(a, b, kind="Static"):
    return {"from": fid(a), "to": fid(b), "kind": kind}


def test_hashes(spark):
    names = ["", "a", "parser::normalize_token", "é::ß", "k" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select("s", fnv1a64_hex(F.col("s")).alias("h"), fnv1a64(F.col("s")).alias("d")).collect()
    assert all(r["h"] == fnv1a64_bytes(r["s"].encode()) and int(r["d"]) == int(r["h"], 16) for r in rows)
    assert rows[0]["h"] == "cbf29ce484222325" and rows[2]["h"] == "5cdb2773caec5ceb"
    times = spark.createDataFrame([(0,), (1609459200,), (1583020800,)], "t long").select(rfc3339(F.col("t"))).collect()
    assert [r[0] for r in times] == ["1970-01-01T00:00:00Z", "2021-01-01T00:00:00Z", "2020-03-01T00:00:00Z"]


def fragments(folder, *parts):
    for i, p in enumerate(parts):
        index.write_fragment(str(folder), f"unit{i}", p)
    return str(folder)


def test_merge(spark, tmp_path):
    run, cat, cage, owl = "zoo::feed_all", "<zoo::Cat as zoo::Animal>::eat", "<zoo::Cage<T> as zoo::Animal>::eat", "<farm::Owl as zoo::Animal>::eat"
    fact = lambda path: {"trait_path": "zoo::Animal", "method": "eat", "fq_path": path, "generic": "<T>" in path}
    folder = fragments(
        tmp_path / "f",
        {"symbols": [symbol(run), symbol(cat), symbol(cage)], "edges": [edge(run, "gone"), edge("nobody", run)], "dyn_calls": [{"owner": fid(run), "trait_path": "zoo::Animal", "method": "eat"}], "impl_methods": [fact(cat), fact(cage)]},
        {"symbols": [symbol(owl), symbol(run, test=True)], "edges": [], "impl_methods": [fact(owl)]},
        {"symbols": [], "edges": []},
    )
    symbols, edges = merge.merge_fragments(index.read_fragments(spark, folder))
    flags = {r["fq_path"]: r["characteristics"]["test"] for r in symbols.collect()}
    assert flags == {run: True, cat: False, cage: False, owl: False}
    got = {(int(r["src"]), int(r["dst"]), r["kind"]) for r in edges.collect()}
    assert got == {(fid(run), fid(p), "Virtual") for p in (cat, cage, owl)} | {(fid(run), fid("gone"), "Static")}


def test_every_collision_is_named(spark, tmp_path):
    parts = [{"symbols": [symbol(f"{unit}::f{i}", id=1000 + i) for i in range(30)], "edges": []} for unit in ("east", "west")]
    with pytest.raises(merge.CollisionError, match="30 symbol id collisions") as e:
        merge.merge_fragments(index.read_fragments(spark, fragments(tmp_path / "f", *parts)))
    told = str(e.value).partition(": ")[2].split("; ")
    assert told == [f"{1000 + i:#x} is east::f{i} and west::f{i}" for i in range(30)]


def workspace(root):
    os.makedirs(root / "src", exist_ok=True)
    (root / "src/till.rs").write_text("pub fn till() -> i8 { 7 }\n")
    (root / "src/stock.rs").write_text("pub struct Stock;\n")
    (root / "Cargo.lock").write_text("[[package]]\n")


def test_source_tree(spark, tmp_path):
    workspace(tmp_path)
    for p in ("target/debug/g.rs", ".hidden/s.rs", "_gen/x.rs", "src/_x.rs", "src/empty.rs", "src/no.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    assert tree.source_files(str(tmp_path)) == ["_gen/x.rs", "src/_x.rs", "src/empty.rs", "src/stock.rs", "src/till.rs"]


def stored(spark, root):
    names = ["shop::price_of", "shop::price_list", "shop::checkout"]
    symbols = [symbol(n) for n in names] + [symbol("shop::tests::by_trait", test=True), symbol("shop::raw_read", uses_unsafe=True)]
    folder = fragments(root / "fragments", {"symbols": symbols, "edges": [edge("shop::tests::by_trait", names[2]), edge(names[2], names[0], "Virtual"), edge(names[0], "shop::raw_read")]})
    index.write_index(str(root), *merge.merge_fragments(index.read_fragments(spark, folder)), drift.fingerprint(spark, str(root), "stable"))


def test_service(spark, tmp_path):
    workspace(tmp_path)
    stored(spark, tmp_path)
    first = (tmp_path / ".tremor/index.bin").read_bytes()
    stored(spark, tmp_path)
    assert (tmp_path / ".tremor/index.bin").read_bytes() == first
    s = Service(spark, str(tmp_path))
    ask = lambda text: json.loads(text)
    paths = lambda rows: [r["fq_path"].rpartition("::")[2] for r in rows]
    found = ask(s.resolve_symbol("price"))
    assert paths(found["data"]) == ["price_list", "price_of"] and found["total"] == 2 and "stale" not in found
    tests = ask(s.affected_tests("price_of"))
    assert paths(tests["data"]) == ["by_trait"] and tests["over_approximated"] == {"DynDispatch": {"trait_path": "<dyn dispatch>", "implementor_count": 1}}
    near = ask(s.direct_calls("shop::price_of"))["data"]
    assert paths(near["callers"]) == ["checkout"] and paths(near["callees"]) == ["raw_read"]
    assert paths(ask(s.reachable_unsafe(str(fid("shop::price_of"))))["data"]) == ["raw_read"]
    assert ask(s.reachability("price_of", "backward"))["total"] == 2
    assert ask(s.neighborhood_graph("price_of"))["data"].startswith("flowchart")
    both = s.impact("price_of")
    assert '"truncated":false' in both and '"boundary_applies":false' in both and {"direct_callers", "affected_tests"} == set(ask(both)["data"])
    way = ask(s.call_paths("by_trait", "raw_read"))["data"]
    assert [paths(p["nodes"]) for p in way] == [["by_trait", "checkout", "price_of", "raw_read"]]
    # several matches are candidates even where the limit is one; an unknown number is a fragment
    one = ask(s.impact("price", 1))
    assert len(one["data"]) == 1 and one["total"] == 2 and one["truncated"]
    assert ask(s.impact("12345"))["total"] == 0
    (tmp_path / "src/till.rs").write_text("pub fn till() -> i8 { 8 }\n")
    (tmp_path / "src/new.rs").write_text("")
    (tmp_path / "src/stock.rs").unlink()
    (tmp_path / "Cargo.lock").write_text("[[package]]\n[[package]]\n")
    assert ask(s.resolve_symbol("raw_read"))["stale"] == {"diverged_files": ["Cargo.lock", "src/new.rs", "src/stock.rs", "src/till.rs"]}


def test_missing_or_foreign_index(spark, tmp_path):
    with pytest.raises(index.IndexError_, match="index.bin"):
        index.read_index(spark, str(tmp_path))
    (tmp_path / ".tremor").mkdir()
    (tmp_path / ".tremor/index.bin").write_text('{"schema_version":2,"symbols":[],"edges":[]}')
    with pytest.raises(index.IndexError_, match="version 2"):
        index.read_index(spark, str(tmp_path))


def test_envelope():
    e = Envelope.exact([1])
    assert e.to_json() == '{"data":[1],"truncated":false,"total":1,"boundary_applies":false}'
    assert '"stale":{"diverged_files":["a"]}' in e.with_stale(["a"]).to_json()


def test_refresh(spark, tmp_path):
    folder, tables = fragments(tmp_path / "in", {"symbols": [symbol("a::x")], "edges": []}), str(tmp_path / "tables")
    refresh(spark, folder, tables, str(tmp_path / "state"))
    index.write_fragment(folder, "late", {"symbols": [symbol("a::y")], "edges": [edge("a::y", "a::x")]})
    refresh(spark, folder, tables, str(tmp_path / "state"))
    symbols, edges = index.load_tables(spark, f"{tables}/merged")
    assert sorted(r["fq_path"] for r in symbols.collect()) == ["a::x", "a::y"] and edges.count() == 1


def test_facts_of_extraction(spark):
    own = spark.createDataFrame([(1, False), (2, True), (3, False)], "id long, unsafe boolean")
    calls = spark.createDataFrame([(1, 2), (3, 1)], "owner long, callee long")
    assert {r["id"]: r["uses_unsafe"] for r in merge.unsafe_owners(own, calls).collect()} == {1: True, 2: True, 3: False}
    edges = spark.createDataFrame([(5, 9, "Static"), (4, 9, "Static")], "src long, dst long, kind string")
    parents = spark.createDataFrame([(5, 4), (4, 1)], "child long, parent long")
    assert [tuple(r) for r in merge.fold_bodies(edges, parents).collect()] == [(1, 9, "Static")]
    calls = spark.createDataFrame([(1, 2, "Item", None, None), (1, 1, "Item", None, None), (1, 3, "Shim", None, None), (2, 3, "Virtual", "t", "m"), (2, 4, "Unresolved", "t", "m"), (2, 5, "Unresolved", None, None)], "owner long, dst long, callee_kind string, trait_path string, method string")
    assert [tuple(r) for r in merge.static_edges(calls.withColumnRenamed("owner", "src")).collect()] == [(1, 2, "Static")]
    assert [tuple(r) for r in merge.record_dyn_calls(calls).collect()] == [(2, "t", "m")]
    items = spark.createDataFrame([("t", "m", "a", "a::<>", False, "fn"), ("t", "m", "b", None, True, "fn"), ("t", "m", "c", None, False, "fn"), ("t", "K", "d", "d", False, "const")], "trait_path string, method string, fq_path string, resolved_path string, generic boolean, item_kind string")
    assert sorted(tuple(r) for r in merge.implementors(items).collect()) == [("t", "m", "a::<>", False), ("t", "m", "b", True)]


def test_marked_tests_of_symbols_with_other_columns(spark):
    flags = "struct<" + ",".join(f"{f}:boolean" for f in FLAGS) + ">"
    symbols = spark.createDataFrame([(1, "a::t", "a", None, (False,) * 6, True, "x"), (2, "a::f", "a", None, (True,) * 6, True, "y")], f"id long, fq_path string, crate_name string, span string, characteristics {flags}, named boolean, __test string")
    constants = spark.createDataFrame([("a::t", "core::test::TestDescAndFn"), ("a::t", "test::TestDescAndFn"), ("a::f", "test::Other")], "fq_path string, type_path string")
    assert {r["id"]: (r["characteristics"]["test"], r["characteristics"]["public"]) for r in merge.mark_tests(symbols, constants).collect()} == {1: (True, False), 2: (False, True)}


def test_compile_units(spark):
    calls = [
        (["rustc", "--crate-name", "one", "src/lib.rs"], True), (["--crate-name=two", "--crate-type", "bin", "main.rs"], True), (["--crate-name", "three", "x.rs"], False), (["x.rs", "--crate-name"], True),
        (["--crate-name", "four", "--crate-type=proc-macro", "x.rs"], True), (["--crate-name", "five", "--crate-type", "lib", "--crate-type", "proc-macro", "x.rs"], True), (["--crate-name=build_script_build", "x.rs"], True), (["--crate-name=six", "-vV"], True),
    ]
    got = index.compile_units(spark.createDataFrame(calls, "args array<string>, primary boolean")).collect()
    assert {(r["crate_name"], r["crate_type"]) for r in got} == {("one", None), ("two", "bin")}
    assert last_part_of(spark, "/opt/toolchains/stable-x86") == "stable-x86" == last_part_of(spark, "stable-x86")


def last_part_of(spark, path):
    return spark.range(1).select(last_part(F.lit(path))).first()[0]


def test_workspace(monkeypatch):
    monkeypatch.delenv("TREMOR_WORKSPACE", raising=False)
    assert index.workspace_root(["x"]) == "x" and index.workspace_root([]) == "."
    monkeypatch.setenv("TREMOR_WORKSPACE", "y")
    assert index.workspace_root([]) == "y"
