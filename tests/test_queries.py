import pytest

from graphs import graph, paths
from tremor.operators import queries as q
from tremor.operators.graph import BACKWARD, FORWARD, reached_from
from tremor.operators.neighborhood import neighborhood
from tremor.plans.workload import QUERIES, symbols_of


SF = "/root/testdata/sf0.001"


def facts(answer):
    f = answer.facts.first()
    return f["total"], f["truncated"], f["over_approximated"], f["implementor_count"], f["boundary_applies"]


def test_resolve(spark):
    g, _ = graph(spark, ["p::price_of", "p::price_list", "p::checkout", "p::PriceTag", "p::fooXbar"])
    assert paths(q.resolve(g, "price")) == ["p::PriceTag", "p::price_list", "p::price_of"]
    assert paths(q.resolve(g, "foo_bar")) == [] and paths(q.resolve(g, "")) == []
    assert facts(q.resolve(g, "price", 2)) == (3, True, False, 0, False)
    assert facts(q.resolve(g, "price", 0))[:2] == (3, True)


def test_direct_calls(spark):
    g, ids = graph(spark, ["a", "b", "c", "d"], "a>b b>c d>b")
    found = q.direct_calls(g, ids["b"])
    assert paths(found, "callers") == ["a", "d"] and paths(found, "callees") == ["c"]
    assert facts(found) == (3, False, False, 0, False)


def test_parallel_edges_count_twice(spark):
    g, ids = graph(spark, ["a", "b"], "a>b a~b")
    assert paths(q.direct_calls(g, ids["a"]), "callees") == ["b", "b"]
    assert q.call_paths(g, ids["a"], ids["b"]).envelope().total == 2


@pytest.mark.parametrize("one_task", [10_000, 0])
def test_reachability(spark, one_task):
    g, ids = graph(spark, ["a", "b", "c", "d", "f", "x"], "a>b b>c c>d c~f f>x b>gone", ["gone"], one_task, foreign=["f"])
    found = q.reachability(g, ids["a"], FORWARD)
    assert paths(found) == ["b", "c", "d"] and facts(found) == (3, False, True, 1, True)
    assert paths(q.reachability(g, ids["d"], BACKWARD)) == ["a", "b", "c"]
    assert facts(q.reachability(g, ids["a"], FORWARD, 2))[:2] == (3, True)
    assert paths(q.reachability(g, ids["x"], BACKWARD)) == []  # a foreign caller is a leaf


@pytest.mark.parametrize("one_task", [10_000, 0])
def test_cycles_and_unknown_start(spark, one_task):
    g, ids = graph(spark, ["a", "b", "c"], "a>b b>c c>a", ["gone"], one_task)
    assert paths(q.reachability(g, ids["a"])) == ["a", "b", "c"]
    assert paths(q.reachability(g, ids["gone"])) == []


def names(answer):
    return ["".join(r["names"]) for r in answer.envelope().data]


def test_call_paths(spark):
    g, ids = graph(spark, list("abcde"), "a>b a>c a>e b>d c~d e>d")
    ask = lambda *more: q.call_paths(g, ids["a"], ids["d"], *more)
    assert names(ask(10, 100)) == ["abd", "acd", "aed"]
    assert facts(ask(10, 3))[:2] == (3, False)
    capped = ask(10, 2)
    assert names(capped) == ["abd", "acd"] and facts(capped)[:4] == (2, True, True, 1)
    assert names(ask(10, 1)) == ["abd"] and facts(ask(10, 1))[:3] == (1, True, True)
    assert facts(ask(1, 5))[:2] == (0, True)


def test_call_paths_odd_cases(spark):
    g, ids = graph(spark, ["a", "b", "f"], "a>b b>a a>f f>b a>gone", ["gone"], foreign=["f"])
    assert names(q.call_paths(g, ids["a"], ids["b"])) == ["ab", "afb"]  # foreign symbols are crossed
    assert names(q.call_paths(g, ids["a"], ids["a"])) == []
    assert facts(q.call_paths(g, ids["a"], ids["b"]))[4]


def test_affected_tests_and_impact(spark):
    g, ids = graph(spark, ["t", "mid", "target", "plain", "other", "dyn"], "t>mid mid>target plain>target dyn~mid t>target", test=["t", "other", "dyn"])
    found = q.affected_tests(g, ids["target"])
    assert paths(found) == ["dyn", "t"] and facts(found)[:4] == (2, False, True, 1)
    both = q.impact(g, ids["target"])
    assert paths(both, "direct_callers") == ["mid", "plain", "t"] and paths(both, "affected_tests") == ["dyn", "t"]
    assert facts(both) == (5, False, True, 1, False)  # a test that calls directly counts twice


def test_reachable_unsafe(spark):
    g, ids = graph(spark, list("abcd"), "a>b b>c a>d", uses_unsafe=["b"])
    assert paths(q.reachable_unsafe(g, ids["a"])) == ["b"]


def text(g, focus, *more):
    return neighborhood(g, focus, *more).envelope()


def test_neighborhood(spark):
    g, ids = graph(spark, ["k::by_trait", "k::run", "k::pay", "k::sack::<Vec<String>>"], "k::by_trait>k::run k::run~k::pay k::pay>re k::pay>k::sack::<Vec<String>>", ["re"])
    found = text(g, ids["k::pay"], 2, 50)
    lines = found.data[0]["text"].split("\n")
    assert lines[:2] == ["flowchart TD", '    n0["k::pay"]:::focus']
    assert '    n2["k::sack::&lt;Vec&lt;String&gt;&gt;"]' in lines
    assert '    b0["external"]:::boundary' in lines and "    n0 ==>|boundary| b0" in lines and "    n1 -.->|dyn| n0" in lines
    assert found.total == 4 and found.boundary_applies and found.over_approximated["DynDispatch"]["implementor_count"] == 1


def test_neighborhood_limits(spark):
    g, ids = graph(spark, ["f", *(f"callee{i}" for i in range(5))], " ".join(f"f>callee{i}" for i in range(5)))
    found = text(g, ids["f"], 1, 3)
    assert found.total == 6 and found.truncated and 'trunc_note["+3 more not shown (total 6)"]:::trunc' in found.data[0]["text"]
    assert text(g, 99).data[0]["text"] == "flowchart TD\n    %% focus symbol id 99 not found in index\n"
    chain, ids = graph(spark, list("abcd"), "a>b b>c c>d")
    assert [text(chain, ids["a"], d, 50).total for d in (1, 2, 3)] == [2, 3, 4]


def test_foreign_focus_is_not_expanded(spark):
    g, ids = graph(spark, ["a", "f"], "a>f", foreign=["f"])
    assert text(g, ids["f"]).total == 1


def test_dispatch_is_widened_for_every_symbol(spark):
    named = symbols_of(spark, SF).count()
    wide = QUERIES["merge_dispatch_edges"](spark, SF)
    assert wide.select("src").distinct().count() == wide.select("target").distinct().count() == named


def test_walks_in_many_levels(spark):
    """More levels than are kept apart, in a circle, from several starts."""
    n = 25
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(100, 101), (102, 103), (103, 100)], "src long, dst long")
    start = spark.createDataFrame([(3,), (102,)], "id long")
    assert sorted(r["id"] for r in reached_from(start, edges).collect()) == [*range(n), 100, 101, 102, 103]
    names = [f"f{i:02}" for i in range(n)]
    g, ids = graph(spark, names, " ".join(f"f{i:02}>f{i + 1:02}" for i in range(n - 1)), one_task_edges=0)
    assert paths(q.reachability(g, ids["f00"])) == names[1:]


def test_answers_give_back_what_they_keep(spark):
    g, ids = graph(spark, ["a", "b", "c"], "a>b b>c")
    for ask in (lambda: q.reachability(g, ids["a"]), lambda: q.impact(g, ids["c"]), lambda: q.call_paths(g, ids["a"], ids["c"])):
        found = ask()
        found.envelope()
        assert found.held and any(df.storageLevel.useMemory for df in found.held)
        found.release()
        assert not any(df.storageLevel.useMemory for df in found.held)
