"""Imports resolved by packages, folders, aliases and entries; diagnostics of open documents."""

import json

from pyspark.sql import functions as F

from quillmesh.plans.code_rules import confidence_text, document_diagnostics
from quillmesh.sources.module_paths import package_entries, resolved_imports

FILES = {
    "/w/package.json": {"workspaces": ["packages/*"]},
    "/w/tsconfig.json": {"compilerOptions": {"paths": {"@all/*": ["shared/*"], "exact": ["shared/one.ts"]}}},
    "/w/packages/a/package.json": {"name": "@o/a", "exports": {".": {"import": "./lib/in.mjs", "default": "./lib/gone.js"}}, "main": "lib/main.js"},
    "/w/packages/a/lib/in.mjs": "", "/w/packages/a/lib/main.js": "", "/w/packages/a/sub/index.js": "", "/w/packages/a/both.ts": "", "/w/packages/a/both/index.ts": "",
    "/w/packages/b/package.json": {"name": "@o/b", "exports": "./start.ts"}, "/w/packages/b/start.ts": "",
    "/w/packages/b/tsconfig.json": {"compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["first/*", "./*"], "~/deep/*": ["deeper/*"]}}},
    "/w/packages/b/src/x.tsx": "", "/w/packages/b/src/first/y.js": "", "/w/packages/b/src/y.js": "", "/w/packages/b/src/deeper/z.ts": "", "/w/packages/b/src/deep/z.ts": "",
    "/w/packages/c/package.json": {"name": "@o/c", "exports": {".": "./e.ts"}, "main": "m.ts"}, "/w/packages/c/m.ts": "", "/w/packages/d/package.json": {"name": "@o/d"}, "/w/packages/d/index.jsx": "",
    "/w/shared/one.ts": "", "/w/app.ts": "", "/outside/o.ts": "",
}
WANTED = [
    ("/w/app.ts", "@o/a", "/w/packages/a/lib/main.js"), ("/w/app.ts", "@o/a/sub", "/w/packages/a/sub/index.js"), ("/w/app.ts", "@o/a/both", "/w/packages/a/both.ts"), ("/w/app.ts", "@o/b", "/w/packages/b/start.ts"),
    ("/w/app.ts", "@o/c", "/w/packages/c/m.ts"), ("/w/app.ts", "@o/d", "/w/packages/d/index.jsx"), ("/w/app.ts", "@o/a/none", None), ("/w/app.ts", "@o/ab", None), ("/w/app.ts", "./packages/a", "/w/packages/a/lib/main.js"),
    ("/w/app.ts", "@all/one", "/w/shared/one.ts"), ("/w/app.ts", "exact", "/w/shared/one.ts"), ("/w/app.ts", "exact/more", None), ("/w/app.ts", "react", None), ("/w/app.ts", "~/x", None),
    ("/w/packages/b/src/x.tsx", "~/y", "/w/packages/b/src/first/y.js"), ("/w/packages/b/src/x.tsx", "~/x", "/w/packages/b/src/x.tsx"), ("/w/packages/b/src/x.tsx", "~/deep/z", "/w/packages/b/src/deeper/z.ts"),
    ("/w/packages/b/src/x.tsx", "../start", "/w/packages/b/start.ts"), ("/w/packages/b/src/x.tsx", "../../../app.ts", "/w/app.ts"), ("/w/packages/b/src/x.tsx", "@all/one", None),
]


def test_imports_by_the_ladder(spark):
    files = spark.createDataFrame([(p, c if isinstance(c, str) else json.dumps(c)) for p, c in FILES.items()], "path string, content string")
    found = spark.createDataFrame([w[:2] for w in WANTED] + [WANTED[0][:2], (None, "x"), ("/w/app.ts", None)], "path string, source string")
    rows = resolved_imports(found, files, "/w").collect()
    assert len(rows) == len(WANTED) and {(r.path, r.source): r.dst for r in rows} == {w[:2]: w[2] for w in WANTED}
    assert {(r.dir[-1], r.ord): r.entry for r in package_entries(files).collect()} == {("a", 0): "/w/packages/a/lib/gone.js", ("a", 1): "/w/packages/a/lib/main.js", ("b", 0): "/w/packages/b/start.ts", ("c", 0): "/w/packages/c/e.ts", ("c", 1): "/w/packages/c/m.ts"}
    assert resolved_imports(found.limit(0), files, "/w").count() == 0


def test_diagnostics_and_confidence(spark):
    findings = spark.createDataFrame([("/A/x.ts", 3, 200), ("/b.ts", 1, 501)], "path string, line int, code int")
    cycles = spark.createDataFrame([(["/a/X.ts", "/c.ts"],)], "cycle array<string>")
    shown = spark.createDataFrame([("file:///a\\X.ts",), ("/c.ts",), ("/d.ts",)], "path string")
    assert sorted(map(tuple, document_diagnostics(findings, cycles, shown).collect()), key=str) == [("/c.ts", "cycle", 1, None), ("file:///a\\X.ts", "cycle", 1, None), ("file:///a\\X.ts", "finding", 3, 200)]
    rows = spark.createDataFrame([(True, None, 3, True), (True, True, 2, None), (None, None, None, False)], "i boolean, s boolean, d int, c boolean")
    texts = [r[0] for r in rows.select(confidence_text(F.lit("low"), F.col("i"), F.col("s"), F.col("d"), F.col("c"))).collect()]
    assert texts == [" Confidence is low because type information is inferred (enable --strict for higher accuracy), involves a 3-level cross-file dependency chain, the setState is inside a conditional block.", "", ""]
