"""Configuration documents found and layered by folder."""

import json

from pyspark.sql import functions as F

from quillmesh.sources import config_documents as cd


def table(spark, rows):
    return spark.createDataFrame([(p, c if c is None or isinstance(c, str) else json.dumps(c)) for p, c in rows.items()], "path string, content string")


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_plain_json(spark):
    texts = {"a": '{"x": "// no /* comment */ , ]", /* c\n, */ "y": [1, 2,], // end\n "z": {"q": 1,},\n}', "b": "{not json", "c": '{"u": "http://x", "e": "\\"//\\""}', "d": None, "e": ""}
    rows = {r.path: r.doc for r in cd.documents(table(spark, {f"/{k}/tsconfig.json": v for k, v in texts.items()}), ["tsconfig.json"]).select("path", F.to_json("doc").alias("doc")).collect()}
    assert json.loads(rows["/a/tsconfig.json"]) == {"x": "// no /* comment */ , ]", "y": [1, 2], "z": {"q": 1}}
    assert rows["/b/tsconfig.json"] is rows["/d/tsconfig.json"] is rows["/e/tsconfig.json"] is None
    assert json.loads(rows["/c/tsconfig.json"]) == {"u": "http://x", "e": '"//"'}


def test_nearest_settings_over_defaults(spark):
    names = ["loops.config.js", "loops.json"]
    files = table(spark, {
        "/w/loops.json": {"stableHooks": ["useA"], "minSeverity": "high", "strictMode": True, "customFunctions": {"later": {"deferred": True}, "b": {"stable": False}}, "ignore": "not a list"},
        "/w/p/q/loops.json": {"ignore": ["**/x"]}, "/w/p/q/loops.config.js": "module.exports = {}", "/w/package.json": {},
    })
    docs = cd.documents(files, names)
    starts = spark.createDataFrame([("/w/p",), ("/w/p/q/r",), ("/w",), ("/other",)], "dir_ string")
    assert {r.dir_: r.path for r in cd.nearest_document(starts, "dir_", docs).collect()} == {"/w/p": "/w/loops.json", "/w": "/w/loops.json", "/w/p/q/r": "/w/p/q/loops.config.js"}
    defaults = {"stableHooks": ["useId"], "minSeverity": "low", "minConfidence": "low", "customFunctions": {"b": {"stable": True}, "c": {"stable": True}}}
    got = {r.dir_: r for r in cd.layered_settings(starts, "dir_", docs, defaults).collect()}
    w = got["/w/p"]
    assert (w.stableHooks, w.minSeverity, w.minConfidence, w.strictMode, w.ignore) == (["useId", "useA"], "high", "low", True, [])
    assert {k: (v.stable, v.deferred) for k, v in w.customFunctions.items()} == {"later": (None, True), "b": (False, None), "c": (True, None)}
    assert got["/w/p/q/r"].ignore == ["**/x"] and got["/w/p/q/r"].minSeverity == "low"  # a module beside it is not read
    assert got["/other"].stableHooks == ["useId"] and set(got["/other"].customFunctions) == {"b", "c"}


def test_dependencies(spark):
    docs = cd.documents(table(spark, {"/a/package.json": {"dependencies": {"x": "1", "y": "1"}, "devDependencies": {"y": "2"}}, "/b/package.json": {"name": "b"}, "/c/package.json": "oops"}), ["package.json"])
    assert sorted(map(tuple, cd.dependencies(docs).collect())) == [("/a/package.json", "x", "1"), ("/a/package.json", "y", "2")]


def test_workspaces_by_precedence(spark):
    files = {
        "/nx/nx.json": {}, "/nx/lerna.json": {"packages": ["no/*"]}, "/nx/package.json": {"workspaces": ["mods/**"]},
        "/turbo/turbo.json": {}, "/lerna/lerna.json": {"packages": ["kits/*"]}, "/lerna/package.json": {"name": "root"},
        "/pnpm/pnpm-workspace.yaml": "# top\npackages:\n  - 'apps/*'\n  # note\n  - \"libs/*\"  # why\n  - '!apps/old'\ncatalog:\n  - no\n", "/yarn/package.json": {"workspaces": {"packages": ["a?", "b/c"]}}, "/none/package.json": {"name": "none"},
    }
    folders = ["/nx/mods/deep/er", "/nx/packages/p", "/turbo/packages/p", "/turbo/apps/p2", "/turbo/packages/p/inner", "/lerna/kits/k", "/lerna/packages/no", "/pnpm/apps/one", "/pnpm/apps/old", "/pnpm/libs/two", "/yarn/a1", "/yarn/ab2", "/yarn/b/c", "/none/packages/x"]
    files |= {f"{f}/package.json": {"name": "pkg" + f.replace("/", "-")} for f in folders} | {"/turbo/libs/nameless/package.json": {}}
    roots = {r.root: (r.kind, r.patterns) for r in cd.workspaces(table(spark, files)).collect()}
    assert roots == {"/nx": ("nx", ["mods/**"]), "/turbo": ("turborepo", cd.PACKAGES), "/lerna": ("lerna", ["kits/*"]), "/pnpm": ("pnpm", ["apps/*", "libs/*", "!apps/old"]), "/yarn": ("yarn", ["a?", "b/c"])}
    got = {(r.root, r.dir) for r in cd.workspace_packages(table(spark, files)).collect()}
    assert got == {("/nx", "/nx/mods/deep/er"), ("/turbo", "/turbo/packages/p"), ("/turbo", "/turbo/apps/p2"), ("/lerna", "/lerna/kits/k"), ("/pnpm", "/pnpm/apps/one"), ("/pnpm", "/pnpm/libs/two"), ("/yarn", "/yarn/a1"), ("/yarn", "/yarn/b/c")}


def test_references(spark):
    files = table(spark, {
        "/w/tsconfig.json": {"references": [{"path": "./a"}, {"path": "b/tsconfig.build.json"}, {"path": "../gone"}]},
        "/w/a/tsconfig.json": {"references": [{"path": "../c"}]}, "/w/c/tsconfig.json": {"references": [{"path": "/w"}]}, "/w/d/tsconfig.json": {"references": "odd"},
    })
    refs = cd.project_references(files)
    assert sorted((r.src, r.dst) for r in refs.collect()) == [("/w/a/tsconfig.json", "/w/c/tsconfig.json"), ("/w/c/tsconfig.json", "/w/tsconfig.json"), ("/w/tsconfig.json", "/gone"), ("/w/tsconfig.json", "/w/a/tsconfig.json"), ("/w/tsconfig.json", "/w/b/tsconfig.build.json")]
    far = cd.all_references(refs, spark.createDataFrame([("/w/a/tsconfig.json",)], "src string"))
    assert {r.dst for r in far.collect()} == {"/w/c/tsconfig.json", "/w/tsconfig.json", "/gone", "/w/b/tsconfig.build.json"}


def test_governing_documents_include_their_files(spark):
    files = table(spark, {
        "/w/tsconfig.json": {"include": ["other/**/*"]}, "/w/app/tsconfig.json": {"include": ["src", "test/*.ts"], "exclude": ["src/**/*.gen.ts"]}, "/w/app/src/lib/tsconfig.json": {"files": ["./only.ts"]}, "/w/kit/tsconfig.json": "{ // all\n}",
    })
    sources = paths(spark, "/w/app/src/a.ts", "/w/app/src/x.gen.ts", "/w/app/test/t.ts", "/w/app/test/deep/t.ts", "/w/app/src/lib/only.ts", "/w/app/src/lib/more.ts", "/w/kit/k.tsx", "/w/kit/node_modules/m.ts", "/w/free.ts", "/w/other/o.ts")
    got = {r.path[3:]: r.document[3:-14] if r.document != "/w/tsconfig.json" else "" for r in cd.governing_document(sources, files, "/w").collect()}
    assert got == {"app/src/a.ts": "app", "app/src/x.gen.ts": "", "app/test/t.ts": "app", "app/test/deep/t.ts": "", "app/src/lib/only.ts": "app/src/lib", "app/src/lib/more.ts": "app", "kit/k.tsx": "kit", "kit/node_modules/m.ts": "", "free.ts": "", "other/o.ts": ""}
    assert [r.document for r in cd.governing_document(sources, files.limit(0), "/w").distinct().select("document").distinct().collect()] == [None]
