"""Pattern index against a plain loop, and JSON documents read back."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import pattern_index as pi
from quillmesh.streaming import sinks
from quillmesh.streaming.document_sink import JsonDocument, report_around, sarif_around

SHAPES = ["^use{}$", "{}", "^{}", "{}$", "{}.*{}", "(?:{}|{})", "{}|{}", "{}?x", "[{}]", "{}+", "a{{2}}{}", "\\.{}", "({})?{}", "{}[^a]b", "\\b{}\\d*", "(?i){}", "{}(b|c)d", "^.{}", "{}{{0,1}}y", "", ".", "\\w+{}\\s?"]


def made(rng):
    word = lambda: "".join(rng.choice("abcdxyUS") for _ in range(rng.choice([1, 2, 3, 5])))
    shape = rng.choice(SHAPES)
    return shape.format(*(word() for _ in range(shape.count("{}")))) if "{}" in shape else shape


def test_pieces_stand_in_every_match():
    rng = random.Random(2)
    names = ["use" + "".join(rng.choice("abcdxyUS.1") for _ in range(rng.randint(0, 8))) for _ in range(400)] + ["", "a"]
    useful = 0
    for p in {made(rng) for _ in range(1500)}:
        pieces = pi.literals(p)
        useful += bool(pieces)
        for n in names:
            if re.search(p, n):
                assert all(x in n for x in pieces), (p, n)
    assert useful > 300
    assert pi.literals("^useUnit\\.of(x)?Store$") == ["useUnit.of", "Store"] and pi.literals("ab|cd") == pi.literals("x*") == []


def test_five_thousand_patterns_equal_a_loop(spark):
    rng = random.Random(7)
    names = sorted({"use" + "".join(rng.choice("abcdxyUS.1") for _ in range(rng.randint(0, 9))) for _ in range(600)}) + [""]
    patterns = set()
    while len(patterns) < 5000:
        patterns.add(made(rng))
    table = spark.createDataFrame([(n, 1) for n in names] + [(names[0], 2), (None, 3)], "name string, pattern int")
    got = [tuple(r) for r in pi.pattern_hits(table, "name", spark.createDataFrame([(p,) for p in [*patterns, None]], "p string"), "p").collect()]
    compiled = [(p, re.compile(p)) for p in patterns]
    want = {(n, p) for n in names for p, c in compiled if c.search(n)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000
    plan = pi.pattern_hits(table, "name", spark.createDataFrame([("x",)], "p string"), "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_long_pieces_spread_names_and_many_patterns_equal_a_loop(spark, monkeypatch):
    """Names are dealt over all cores and never broadcast; more patterns than may be broadcast are shuffled, with the same hits."""
    names = [f"Customer#{k:09d}" for k in range(400)] + ["a", ""]
    patterns = [f"er#0*{k}$" for k in range(300)] + [f"^Supplier#{k:09d}$" for k in range(50)] + ["^Customer.*7.?$", "(1|2)3$", "Customer#0+1[0-5]$", "^$"]
    table, rules = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {(n, p) for n in names for p in patterns if re.search(p, n)}
    for few in (pi.FEW, 0):
        monkeypatch.setattr(pi, "FEW", few)
        hits = pi.pattern_hits(table, "name", rules)
        got = [tuple(r) for r in hits.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert few or "SortMergeJoin" in plan
        if few:
            assert hits.rdd.getNumPartitions() >= 4
    # a pattern waits under its whole number, so that few names meet it in vain
    assert pi._pieces("12345") == ["12345"] and pi._pieces("Supplier#00012") == ["Supplier", "er#00012"]


def test_names_presets_and_custom_functions(spark):
    rules = spark.createDataFrame([("stable", "useStore", False), ("unstable", "^useRaw", True), ("stable", "Query$", True), ("unstable", "useStore", False)], "kind string, value string, is_pattern boolean")
    names = spark.createDataFrame([("useStore",), ("useRawQuery",), ("useQuery",), ("other",), (None,)], "hook string")
    assert {r.hook: (r.stable, r.unstable) for r in pi.judged_names(names, "hook", rules).collect()} == {"useStore": (True, True), "useRawQuery": (True, True), "useQuery": (True, False), "other": (False, False)}
    presets = spark.createDataFrame([("lib-a", "stable", "useA"), ("lib-a2", "stable", "useA"), ("lib-b", "unstable", "useB")], "package string, kind string, value string")
    needs = spark.createDataFrame([("p", "lib-a"), ("p", "lib-a2"), ("q", "lib-b"), ("q", "none")], "project string, package string")
    assert sorted(map(tuple, pi.preset_rules(needs, presets).collect())) == [("p", "stable", "useA"), ("q", "unstable", "useB")]
    declared = spark.createDataFrame([("later", False, True)], "name string, stable boolean, deferred boolean")
    assert {r.hook: r.deferred for r in pi.custom_functions(spark.createDataFrame([("later",), ("now",)], "hook string"), "hook", declared).collect()} == {"later": True, "now": None}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_documents_read_back(spark, tmp_path, n):
    spark.dataSource.register(JsonDocument)
    rows = spark.range(n).repartition(7).select(sinks.sarif_result(F.concat(F.lit("R"), (F.col("id") % 3).cast("string")), F.lit("error"), F.concat(F.lit('say "é" '), F.col("id").cast("string")), F.lit("/a b.ts"), F.col("id")).alias("json"))
    head, tail = sarif_around(sinks.sarif_head(spark.createDataFrame([("R0", "first"), ("R1", "second")], "id string, text string"), "id", "text").first().json)
    path = str(tmp_path / "out.sarif")
    rows.write.format("json_document").option("path", path).option("head", head).option("tail", tail).mode("append").save()
    doc = json.load(open(path, encoding="utf-8"))
    results = doc["runs"][0]["results"]
    assert doc["version"] == "2.1.0" and [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["R0", "R1"]
    assert sorted(r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in results) == list(range(n)) and all(r["message"]["text"].startswith('say "é" ') for r in results)
    with pytest.raises(Exception, match="exist|Exist"):
        rows.write.format("json_document").option("path", path).mode("append").save()
    head, tail = report_around({"version": "1", "durationMs": 3})
    rows.write.format("json_document").option("path", path).option("head", head).option("tail", tail).mode("overwrite").save()
    doc = json.load(open(path, encoding="utf-8"))
    assert doc["meta"]["durationMs"] == 3 and len(doc["findings"]) == n
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
