"""Aliases, folders, layers, manifests and intervals on small tables with odd rows."""

from pyspark.sql import functions as F

from quillmesh.operators import relational as rel, resolution as res


def test_aliases_and_folders(spark):
    wanted = spark.createDataFrame([(1, "@app/ui/x"), (2, "@app"), (3, "@apple/x"), (4, "other"), (5, None)], "id int, source string")
    aliases = spark.createDataFrame([("@app", "/a", 0), ("@app", "/b", 1), ("@app/ui", "/ui", 0)], "alias string, target string, ord int")
    got = [tuple(r) for r in res.expand_aliases(wanted, "source", aliases).orderBy("id", "prio").collect()]
    assert got == [(1, "@app/ui/x", 0, "/ui/x"), (2, "@app", 0, "/a"), (2, "@app", 1, "/b")]
    paths = spark.createDataFrame([(1, "/p/q/r.ts"), (2, "/p/s.ts"), (3, "top.ts"), (4, None)], "id int, path string")
    known = spark.createDataFrame([("/p/q",), ("/p",), ("/p/q",), (None,)], "dir string")
    assert {r.id: r.nearest for r in res.nearest_ancestor(paths, "id", "path", known, "dir").collect()} == {1: "/p/q", 2: "/p", 3: None, 4: None}


def test_settings_and_manifests(spark):
    rows = spark.createDataFrame([("ignore", "a", 0, 0), ("ignore", "b", 0, 1), ("ignore", "c", 1, 0), ("ignore", "a", 1, 1)], "name string, value string, layer int, ord int")
    assert [tuple(r) for r in res.merged_lists(rows, "name", "value", ["layer", "ord"]).collect()] == [("ignore", ["a", "b", "c"])]
    assert [tuple(r) for r in res.merged_scalars(rows, "name", "value", ["layer", "ord"]).collect()] == [("ignore", "a")]
    old = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "path string, md5 string")
    new = spark.createDataFrame([("y", "2"), ("z", None), ("w", "1")], "path string, md5 string")
    assert {tuple(r) for r in res.manifest_changes(old, new, "path", "md5").collect()} == {("x", "removed"), ("y", "changed"), ("w", "added")}
    used = spark.createDataFrame([("f", "a"), ("f", "b")], "path string, local string")
    assert {tuple(r) for r in res.original_names(used, "local", spark.createDataFrame([("f", "a", "orig")], "path string, local string, imported string")).collect()} == {("f", "a", "orig"), ("f", "b", "b")}


def test_intervals_and_ladders(spark):
    points = spark.range(-5, 30).select(F.col("id").cast("double").alias("x")).union(spark.sql("select cast(null as double)"))
    ranges = spark.createDataFrame([("a", -3.0, 4.0), ("b", 4.0, 25.0), ("c", 9.0, 2.0), ("d", None, 3.0)], "name string, lo double, hi double")
    for width in (0.7, 3.0, 100.0):
        got = {(r.x, r.name) for r in rel.interval_lookup(points, ranges, [], "x", "lo", "hi", width=width).collect()}
        assert got == {(float(x), n) for x in range(-5, 30) for n, lo, hi in (("a", -3, 4), ("b", 4, 25)) if lo <= x <= hi}
    first = rel.interval_lookup(points, ranges, [], "x", "lo", "hi", ["name"], ["x"]).where("x = 4").collect()
    assert [r.name for r in first] == ["a"]
    rows = spark.createDataFrame([(1, 2, 5), (1, 1, 0), (2, 1, 9), (3, 1, 1)], "k int, pos int, v int")
    got = rel.ladder(rows, [("v > 8", "stop"), ("v > 0", "hit")], ["k"], ["pos"], ["pos"]).collect()
    assert {tuple(r) for r in got} == {(1, 2, 2, "hit"), (3, 1, 2, "hit")}
    ties = spark.createDataFrame([("p", 1, "a", "x"), ("p", 1, "b", None)], "k string, at int, u string, v string")
    assert tuple(rel.last_write(ties, ["k"], "at", "u", "v").first())[1:] in (("a", "x"), ("b", None))
    lines = spark.createDataFrame([(1, "one\ntwo !!\n\nskip\nthree"), (2, None), (3, "")], "id int, text string")
    assert [(r.line_no, r.line) for r in rel.unignored_lines(lines, "id", "text", "!!", "skip").collect()] == [(0, "one"), (3, "skip")]
