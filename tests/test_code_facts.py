"""Source facts, rules and cycles on small files of our own."""

from quillmesh.plans.code_rules import hook_findings, import_cycles
from quillmesh.sources import code_facts as facts

FILES = {
    "/p/a.tsx": """import React, { useState, useEffect } from 'react';
import B, { c as d } from './b';
import * as U from "../p/util";
export const A = () => {
  const [count, setCount] = useState(0);
  const [name, setName] = useState('');
  useEffect(() => { setCount(count + 1); }, [count]);
  useEffect(() => { if (name !== 'x') setName('x'); }, [name]);
  useEffect(() => { setName('y'); });
  const f = useCallback(() => { setCount(c => c + 1); }, [count]);
  const g = useCallback(() => { setCount(count + 1); }, [count]);
  // loop-ignore-next-line
  useEffect(() => { setCount(count + 2); }, [count]);
  useEffect(() => { console.log(1); }, []);
};
""",
    "/p/b.ts": "import { A } from './a';\nexport default function B() {}\nconst x = require('./util');\n",
    "/p/util/index.ts": "export const u = 1;\nimport('./missing');\n",
}


def table(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


def test_facts(spark):
    files = table(spark)
    got = {(r.path, r.source): (r.names, r.is_default, r.is_namespace, r.line) for r in facts.imports(files).collect()}
    assert got["/p/a.tsx", "./b"] == (["B", "d"], True, False, 2)
    assert got["/p/a.tsx", "../p/util"] == (["U"], False, True, 3)
    assert ("/p/b.ts", "./util") in got and ("/p/a.tsx", "react") not in got
    edges = {(r.src, r.dst) for r in facts.module_edges(facts.imports(files), files).collect()}
    assert edges == {("/p/a.tsx", "/p/b.ts"), ("/p/a.tsx", "/p/util/index.ts"), ("/p/b.ts", "/p/a.tsx"), ("/p/b.ts", "/p/util/index.ts")}
    assert {(r.state, r.setter) for r in facts.state_pairs(files).collect()} == {("count", "setCount"), ("name", "setName")}
    assert {(r.name, r.is_default) for r in facts.exports(files).collect()} == {("A", False), ("B", True), ("u", False)}
    hooks = [(r.line, r.hook, r.deps) for r in facts.hooks(files).orderBy("line").collect()]
    assert hooks == [(7, "useEffect", ["count"]), (8, "useEffect", ["name"]), (9, "useEffect", None), (10, "useCallback", ["count"]), (11, "useCallback", ["count"]), (13, "useEffect", ["count"]), (14, "useEffect", [])]
    assert facts.likely_react(files).count() == 1


def test_rules_and_cycles(spark):
    files = table(spark)
    assert {(r.line, r.code, r.type) for r in hook_findings(files).collect()} == {
        (7, 200, "confirmed-infinite-loop"), (8, 501, "potential-issue"), (9, 201, "confirmed-infinite-loop"), (11, 420, "potential-issue"),
    }
    assert [r.cycle for r in import_cycles(files).collect()] == [["/p/a.tsx", "/p/b.ts"]]
    assert hook_findings(files.limit(0)).count() == 0
