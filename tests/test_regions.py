"""Nesting regions, hook facts and findings on shapes that a pattern alone reads wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators.relational import interval_lookup
from quillmesh.plans import source_queries
from quillmesh.plans.code_rules import hook_findings
from quillmesh.sources import regions
from quillmesh.sources.code_facts import exports, hook_calls, hooks, imports, renamed_imports, state_pairs
from quillmesh.sources.regions import matches, nesting, region_table, tokenized


def brute(files):
    """Mates and regions of files of brackets and dots, by a stack that drops what can't pair off by depth."""
    mates, regions = [], []
    for text in files:
        mate, region, depth_of = [-1] * len(text), [-1] * len(text), []
        depth, open_at = 0, {}
        for k, c in enumerate(text):
            if c == ")":
                depth -= 1
                if depth in open_at:
                    mate[k], mate[open_at[depth]] = open_at[depth], k
                    del open_at[depth]
            depth_of.append(depth)
            if c == "(":
                open_at[depth] = k
                depth += 1
        last = {}
        for k, c in enumerate(text):
            region[k] = last.get(depth_of[k] - 1, -1)
            if c == "(":
                last[depth_of[k]] = k
        mates.append(mate)
        regions.append(region)
    return mates, regions


@pytest.mark.parametrize("seed", range(5))
def test_nesting_equals_a_stack(seed):
    rng = random.Random(seed)
    files = ["".join(rng.choice("().") for _ in range(rng.choice([0, 1, 2, 30, 200]))) for _ in range(30)] + ["((.)(.(.)))", "", ")(", "(" * 50 + ")" * 50]
    flat = "".join(files)
    starts = np.cumsum([0, *map(len, files)])[:-1]
    mate, region = nesting(np.array([{"(": 1, ")": -1}.get(c, 0) for c in flat], np.int64), starts)
    want_mate, want_region = brute(files)
    for f, start, m, r in zip(files, starts, want_mate, want_region, strict=True):
        own = lambda x: [int(v - start) if v >= 0 else -1 for v in x]  # noqa: B023, E731
        assert own(mate[start : start + len(f)]) == m and own(region[start : start + len(f)]) == r


HEAD = "const [mood, setMood] = useState(0);\nconst [items, setItems] = React.useState<Map<string, number[]>>(make());\nconst [row, dispatchRow] = useReducer(step, {});\n"
#: Body, and code, hook and dependency of each finding with plain conditions, and with guards trusted where that differs.
SHAPES = {
    "expression body": ("useEffect(() => setMood(1), [mood]);", [(200, "mood")], None),
    "other dependency": ("useEffect(() => setMood(1), [items]);", [], None),
    "entry with brackets": ("useEffect(() => { setItems(1); }, [items[0], items.size]);", [(200, "items")], None),
    "commented out": ("// useEffect(() => { setMood(1); }, [mood]);\n/* useEffect(() => setMood(2)); */", [], None),
    "call after the hook": ("useEffect(() => { log(1); });\nsetMood(3);", [], None),
    "call in a text": ("useEffect(() => { log('setMood('); log(\"setMood(1)\"); log(`setMood(${1})`); }, [mood]);", [], None),
    "nested braces": ("useEffect(() => { const a = { b: { c: [1, { d: 2 }] } }; for (const x of a.b.c) { log(x); } setMood({ ...a }); }, [mood]);", [(200, "mood")], None),
    "no array": ("useEffect(() => setMood(1));", [(201, "mood")], None),
    "array by name": ("useEffect(() => setMood(1), list);", [], None),
    "trailing commas": ("useEffect(\n  () => {\n    setMood(1);\n  },\n  [\n    items,\n    mood,\n  ],\n);", [(200, "mood")], None),
    "deferred": ("useEffect(() => { const t = setTimeout(() => { setMood(mood + 1); }, 5); return () => clearTimeout(t); }, [mood]);", [(200, "mood", "safe-pattern")], None),
    "promise": ("useEffect(() => { load().then(x => setItems(x)); }, [items]);", [(200, "items", "safe-pattern")], None),
    "cleanup": ("useEffect(() => { log(1); return () => setMood(0); }, [mood]);", [(200, "mood")], None),
    "cleanup in braces": ("useEffect(() => { if (x) log(1); return function () { setMood(0); }; }, [mood]);", [(200, "mood")], None),
    "if without braces": ("useEffect(() => { if (mood < 3) setMood(mood + 1); log(2); }, [mood]);", [(501, "mood")], None),
    "after an if": ("useEffect(() => { if (mood < 3) log(1); setMood(mood + 1); }, [mood]);", [(200, "mood")], None),
    "else": ("useEffect(() => { if (ready) { log(1); } else { setMood(2); } }, [mood]);", [(501, "mood")], None),
    "early return": ("useEffect(() => { if (mood > 3) return; setMood(mood + 1); }, [mood]);", [(501, "mood")], None),
    "and": ("useEffect(() => { ready && setMood(mood + 1); }, [mood]);", [(501, "mood")], None),
    "unequal": ("useEffect(() => { if (mood !== 3) setMood(3); }, [mood]);", [(501, "mood")], [(200, "mood", "safe-pattern")]),
    "toggle": ("useEffect(() => { if (!mood && ready) { setMood(true); } }, [mood]);", [(501, "mood")], [(200, "mood", "safe-pattern")]),
    "exit on equal": ("useEffect(() => { if (mood === 3) { return; } setMood(3); }, [mood]);", [(501, "mood")], [(200, "mood", "safe-pattern")]),
    "property and new object": ("useEffect(() => { if (row.id !== 5) dispatchRow({ ...row, id: 5 }); }, [row.id]);", [(501, "row")], [(410, "row")]),
    "property": ("useEffect(() => { if (row.id !== 5) dispatchRow(5); }, [row]);", [(501, "row")], [(200, "row", "safe-pattern")]),
    "memo": ("const go = useCallback(() => { setMood(mood + 1); }, [mood]);", [(420, "mood")], None),
    "memo with update": ("const go = useCallback(() => { setMood((m) => m + 1); }, [mood]);", [], None),
    "method of that name": ("useEffect(() => { props.setMood(1); }, [mood]);", [], None),
    "silenced": ("// loop-ignore-next-line\nuseEffect(() => setMood(1), [mood]);\nuseEffect(() => setMood(1), [mood]); // loop-ignore", [], None),
    "first dependency counts": ("React.useLayoutEffect(() => { setItems(1); setMood(1); }, [row, items, mood]);", [(200, "items")], None),
    "two on a line": ("useEffect(() => setMood(1), [mood]); useEffect(() => setItems(1), [items]);", [(200, "items"), (200, "mood")], None),
    "pattern with a quote": ("const p = /['\"(]/g; useEffect(() => { setMood(x.replace(/\\(/, '')); }, [mood]);", [(200, "mood")], None),
    "markup with an apostrophe": ("useEffect(() => setMood(1), [mood]);\nreturn <p>don't {mood}</p>;", [(200, "mood")], None),
    "cut off": ("useEffect(() => { setMood(1); }, [mood]", [], None),
}


def table(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in rows.items()], "path string, content string")


@pytest.mark.parametrize("trust", [False, True])
def test_findings_of_shapes(spark, trust):
    files = table(spark, {name: HEAD + body for name, (body, _, _) in SHAPES.items()})
    got = {name: [] for name in SHAPES}
    for r in hook_findings(files, trust_guards=trust).collect():
        got[r.path].append((r.code, r.dependency, r.type))
    for name, (_, plain, trusted) in SHAPES.items():
        want = trusted if trust and trusted is not None else plain
        assert sorted(x[: len(want[0]) if want else 3] for x in got[name]) == sorted(want), name
        assert all(len(w) == 3 or g[2] != "safe-pattern" for w, g in zip(want, sorted(got[name]), strict=True))


def test_tokens_lines_and_hooks(spark):
    files = table(spark, {"a": "f('(')\n  // ) \n[x, {\n}]", "b": "", "c": "useMemo(() => 1, [a.b, 'k', ...rest, c?.d, !e, f])", "d": "\n\nfunction useEffect(a) {}\nuseEffect(run, [b]); x.useEffect(c)"})
    files = files.union(files.sparkSession.createDataFrame([("n", None)], files.schema))
    rows = {r.path: r.tokens for r in tokenized(files).collect()}
    assert [(t.text, t.line, t.mate, t.region) for t in rows["a"]] == [("f", 1, -1, -1), ("(", 1, 3, -1), ("''", 1, -1, 1), (")", 1, 1, -1), ("[", 3, 9, -1), ("x", 3, -1, 4), (",", 3, -1, 4), ("{", 3, 8, 4), ("}", 4, 7, 4), ("]", 4, 4, -1)]
    assert rows["b"] == rows["n"] == []
    assert [(r.path, r.hook, r.line, r.deps) for r in hooks(files).orderBy("path").collect()] == [("c", "useMemo", 1, ["a", "c", "f"]), ("d", "useEffect", 4, ["b"])]
    assert state_pairs(table(spark, {"x": "const [a, setA] = useState(1); const [a, putA] = useState<A>(2); let [b, c] = other();"})).collect()[0][1:] == ("a", "putA")


def test_innermost_region_by_interval_join(spark):
    text = "function A() {\n  run(() => {\n    go(1);\n  });\n}\nfunction B() {\n  go(2);\n}\n"
    files = table(spark, {"x": text})
    regions = region_table(files).where("bracket = '{'").withColumn("size", F.expr("last - first"))
    lines = spark.createDataFrame([("x", k) for k in range(1, 9)], "path string, at_line int")
    hit = interval_lookup(lines, regions.drop("at"), ["path"], "at_line", "line", "end_line", ["size"], ["path", "at_line"], width=4.0)
    assert {r.at_line: (r.line, r.end_line) for r in hit.collect()} == {1: (1, 5), 2: (2, 4), 3: (2, 4), 4: (2, 4), 5: (1, 5), 6: (6, 8), 7: (6, 8), 8: (6, 8)}


def test_one_scan_without_a_shuffle_of_contents(spark):
    plan = hook_calls(table(spark, {"x": HEAD}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    plan = hook_findings(table(spark, {"x": HEAD}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_imports_and_exports_outside_comments_and_texts(spark):
    text = """// import a from './a';
/* import b from './b';
*/ import c, { d as e } from './c'; /* x */ import * as f /* y */ from
  './f';
const s = "import g from './g'", t = `require('./h')`;
const u = require('./u');
export { c, e as default, type T, f as ff };
export const V = React.memo(() => null);
export { w } from './w';
// export { no };
"""
    files = table(spark, {"/p": text, "/empty": "", "/q": "no"})
    files = files.union(spark.createDataFrame([("/n", None)], files.schema))
    assert sorted((r.source, r.names, r.line) for r in imports(files).collect()) == [("./c", ["c", "e"], 3), ("./f", ["f"], 3), ("./u", [], 6)]
    assert [(r.local, r.imported) for r in renamed_imports(files).collect()] == [("e", "d")]
    assert sorted((r.name, r.is_default, r.is_memoized, r.line) for r in exports(files).collect()) == [("V", False, True, 8), ("c", False, False, 7), ("default", True, False, 7), ("ff", False, False, 7), ("w", False, False, 9)]
    assert [(r.ord, r.line, r.x) for r in matches(table(spark, {"a": "k1\n k2 'k3' k4"}), r"k(\d)", "x").orderBy("ord").collect()] == [(0, 1, "1"), (1, 2, "2"), (2, 2, "4")]
    plan = imports(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_of_one_content_are_read_once_and_all_get_their_rows(spark, monkeypatch):
    """Every file keeps its own rows, and the scan sees each content of a batch once; only a part of a batch is read at a time."""
    contents = [HEAD, HEAD + "\n// other", None, "", "const [a, setA] = useState(1);"]
    files = spark.createDataFrame([(f"/f{k}", contents[k * k % 5], k) for k in range(60)], "path string, content string, size int").coalesce(1)
    for together in (regions._TOGETHER, 1):
        monkeypatch.setattr(regions, "_TOGETHER", together)
        rows = regions.read_once(files, "size").collect()
        assert len(rows) == len({r.content for r in rows}) == len({contents[k * k % 5] or "" for k in range(60)})
        assert sorted((f.path, f["size"], r.content) for r in rows for f in r.files) == sorted((f"/f{k}", k, contents[k * k % 5] or "") for k in range(60))
        alone = {c or "": regions._tokens([c or ""]).to_pylist()[0] for c in contents}
        assert {r.path: [t.asDict() for t in r.tokens] for r in regions.tokenized(files).collect()} == {f"/f{k}": alone[contents[k * k % 5] or ""] for k in range(60)}


def test_large_tables_are_read_by_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    spark.range(50).select("id", "id").toDF("o_orderkey", "x").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(source_queries, "TOGETHER", 2)
    assert source_queries.spread(spark, str(tmp_path), "orders", "o_orderkey").rdd.getNumPartitions() == 25
