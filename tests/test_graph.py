"""Graph operators on chains and cycles longer than any fixed depth."""

import random

from quillmesh.operators import flow, graph
from quillmesh.plans.code_rules import import_cycles
from quillmesh.streaming.incremental import affected


def test_long_import_cycle(spark):
    files = spark.createDataFrame([(f"/p/f{k}.ts", f'import {{ x }} from "./f{(k + 1) % 9}";') for k in range(9)], "path string, content string")
    assert [r.cycle for r in import_cycles(files).collect()] == [[f"/p/f{k}.ts" for k in range(9)]]


def test_all_simple_cycles(spark):
    edges = [(a, b) for a in range(5) for b in range(5)] + [(4, 9), (9, 10)]
    found = [tuple(r.cycle) for r in graph.simple_cycles(spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert len(found) == len(set(found)) == 5 + 10 + 20 + 30 + 24


def test_far_dependents(spark):
    edges = spark.createDataFrame([(f"f{k + 1}", f"f{k}") for k in range(103)], "src string, dst string")
    assert affected(spark.createDataFrame([("f0",)], "path string"), edges).count() == 104


def test_dominators_of_many_graphs(spark):
    """Random graphs by key against removal of each node."""
    rnd = random.Random(6)
    edges = [(g, a, b) for g in range(6) for a in range(9) for b in range(9) if rnd.random() < 0.16]
    got = {tuple(r) for r in graph.dominators(spark.createDataFrame(edges, "graph int, src int, dst int"), roots=spark.createDataFrame([(g, 0) for g in range(6)], "graph int, node int")).collect()}

    def reach(g, out):
        seen, todo = set(), [0] if out != 0 else []
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += [b for k, a, b in edges if k == g and a == n and b != out]
        return seen

    assert got == {(g, n, d) for g in range(6) for n in reach(g, None) for d in reach(g, None) if n not in reach(g, d)}


def test_propagation_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("c", "setX"), ("b", "setY"), ("f", None)], "node string, value string")
    got = {tuple(r) for r in graph.propagated(edges, seeds).collect()}
    assert {x for x in got if x[1]} == {(n, v) for n in "abcd" for v in ("setX", "setY")}
    assert {tuple(r) for r in graph.cycle_members(edges).collect()} == {("b", 2), ("c", 2)}
    assert graph.cycle_members(edges.limit(0)).count() == 0 and graph.propagated(edges, seeds.limit(0)).count() == 0


def _reach(edges, start, out=None):
    seen, todo = set(), [start]
    while todo:
        if (n := todo.pop()) not in seen and n != out:
            seen.add(n)
            todo += [b for a, b in edges if a == n]
    return seen


def test_strong_parts(spark):
    rnd = random.Random(8)
    for n, share in ((30, 0.03), (30, 0.06), (12, 0.3)):
        edges = [(a, b) for a in range(n) for b in range(n) if rnd.random() < share]
        got = {r.node: r.part for r in graph.strong_parts(spark.createDataFrame([*edges, (None, 1), (1, None)], "src int, dst int")).collect()}
        reach = {a: _reach(edges, a) for a in range(n)}
        assert got == {a: min(b for b in reach[a] if a in reach[b]) for e in edges for a in e}
        inner = {tuple(r) for r in graph.inner_edges(spark.createDataFrame(edges, "src int, dst int")).collect()}
        assert inner == {(a, b) for a, b in edges if a in reach[b]}
    assert graph.strong_parts(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_strong_parts_broadcast_nothing(spark):
    parts = graph.strong_parts(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src int, dst int"))
    assert {tuple(r) for r in parts.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert "Broadcast" not in parts._jdf.queryExecution().executedPlan().toString()


def test_dominator_trees(spark):
    rnd = random.Random(4)
    edges = [(g, a, b) for g in range(8) for a in range(10) for b in range(10) if rnd.random() < 0.15] + [(9, k, k + 1) for k in range(10_000)]
    table, roots = spark.createDataFrame(edges, "graph int, src int, dst int"), spark.createDataFrame([(g, 0) for g in [*range(8), 9, 20]], "graph int, node int")
    rows = graph.dominator_tree(table, roots).collect()
    chain = {r.node: r for r in rows if r.graph == 9}
    assert len(chain) == 10_001 and chain[0].idom is None and all(chain[k].idom == k - 1 for k in range(1, 10_001)) and chain[0].enter < chain[10_000].enter and chain[10_000].leave <= chain[0].leave
    assert [(r.node, r.idom) for r in rows if r.graph == 20] == [(0, None)]
    for g in range(8):
        own, mine = {r.node: r for r in rows if r.graph == g}, [(a, b) for k, a, b in edges if k == g]
        assert set(own) == _reach(mine, 0)
        got = {(a, b) for a in own for b in own if own[a].enter <= own[b].enter and own[b].leave <= own[a].leave}
        assert got == {(a, b) for a in own for b in own if b == a or b not in _reach(mine, 0, a)}
    exits = spark.createDataFrame([(g, 9) for g in range(8)], "graph int, node int")
    sure = {tuple(r) for r in graph.guaranteed(spark.createDataFrame(rows, graph.dominator_tree(table, roots).schema), exits).collect() if r.graph < 8}
    for g in range(8):
        mine = [(a, b) for k, a, b in edges if k == g]
        want = {n for n in _reach(mine, 0) if n in (0, 9) or 9 not in _reach(mine, 0, n)} if 9 in _reach(mine, 0) else {0}
        assert {n for k, n in sure if k == g} == want | {9}


def test_flows_of_last_calls(spark):
    functions = [("save", "a", False, 0, ["setOld"]), ("save", "b", True, 1, ["setX"]), ("save", "c", True, 2, ["setY", "setX"]), ("load", "a", False, 3, []), ("load", "b", False, 4, ["setNo"]), ("loop", "a", True, 5, ["setL"])]
    inner = [("load", "a", 0, "loop"), ("load", "a", 1, "save"), ("load", "b", 0, "save"), ("loop", "a", 0, "load"), ("loop", "a", 1, "none"), ("save", "a", 0, "loop")]
    calls = [("h1", 1, "save", 1), ("h1", 2, "load", 1), ("h1", 3, "save", 0), ("h1", 4, "none", 2), ("h2", 1, "load", 0), ("h3", 5, "loop", 1), ("h3", 1, "save", 3)]
    got = flow.setter_flows(
        spark.createDataFrame(calls, "hook string, ord int, name string, passes int"), spark.createDataFrame(functions, "name string, file string, exported boolean, ord int, setters array<string>"),
        spark.createDataFrame(inner, "name string, file string, ord int, callee string"),
    )
    assert {(r.hook, r.call): r.setters for r in got.collect()} == {("h1", 2): ["setL", "setY", "setX"], ("h3", 5): ["setL", "setY", "setX"]}


def test_first_derivations_are_those_of_a_walk(spark):
    rnd = random.Random(3)
    edges = sorted({(a, k, rnd.randrange(9)) for a in range(9) for k in range(rnd.choice([0, 1, 3]))})
    got = {(r.src, r.dst): list(r.path) for r in graph.first_derivations(spark.createDataFrame([(a, b, k) for a, k, b in edges], "src int, dst int, ord int"), spark.createDataFrame([(a,) for a in range(9)], "src int")).collect()}

    def walk(at, path, seen):
        yield at, path
        for a, k, b in edges:
            if a == at and b not in seen:
                yield from walk(b, [*path, k], seen | {b})

    want = {}
    for a in range(9):
        for b, path in walk(a, [], {a}):
            want.setdefault((a, b), path)
    assert got == want
