"""Findings over source facts: an ordered ladder of rules over the setter calls of each hook, and import cycles.

A hook yields one finding at most, that of its first dependency and first step. Findings on ignored lines are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import graph, relational as rel
from quillmesh.sources import code_facts as facts
from quillmesh.sources.regions import by_file

#: Fixed values: (type, code, severity, confidence) of each action.
ACTIONS = {
    "safe": ("safe-pattern", 200, "low", "high"),
    "loop": ("confirmed-infinite-loop", 200, "high", "high"),
    "no-deps": ("confirmed-infinite-loop", 201, "high", "high"),
    "spread": ("potential-issue", 410, "medium", "medium"),
    "guarded": ("potential-issue", 501, "medium", "medium"),
    "memo": ("potential-issue", 420, "low", "medium"),
}
#: Calls that run their callbacks later.
DEFERRING = ["setTimeout", "setInterval", "requestAnimationFrame", "requestIdleCallback", "then", "catch", "finally", "onSnapshot", "onAuthStateChanged", "onValue", "onChildAdded", "onChildChanged", "onChildRemoved", "subscribe", "observe", "addEventListener"]
_BRANCHING = ["if", "while", "for", "switch", "catch"]


def _struct(**fields: Column) -> Column:
    """A struct by names, which fields of structs made inside lambdas lose otherwise."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def setter_sites(body: str, setter: Column) -> Column:
    """A struct for each call of ``setter`` in a hook's tokens: where it stands and under what conditions.

    ``conditions`` are the texts of the tests of enclosing ifs and ``and``s, ``exits`` those of ifs before it that return.
    """
    base = F.get(body, F.lit(0))["at"]
    token = lambda at: F.get(body, F.greatest(at - base, F.lit(-1)))
    text = lambda at: F.coalesce(F.when(at >= base, token(at)["text"]), F.lit(""))
    joined = lambda first, last: F.array_join(F.transform(F.slice(body, first - base + 1, F.greatest(last - first + 1, F.lit(0))), lambda t: t["text"]), " ")
    none = lambda test: ~F.exists(body, test)
    straight = lambda a, s: none(lambda x: (x["at"] > a["at"]) & (x["at"] < s["at"]) & (x["region"] == a["region"]) & (x["text"] == ";"))
    inside = lambda a, s: (a["at"] < s["at"]) & ((a["region"] < base) | (token(a["region"])["mate"] > s["at"]))
    block = lambda at, s: (text(at) == "{") & (at < s["at"]) & (token(at)["mate"] > s["at"])
    test_end = lambda p: token(p["at"] + 1)["mate"]
    tests = lambda p: (text(p["at"] + 1) == "(") & (test_end(p) >= 0)

    def under(p: Column, s: Column) -> Column:
        """Whether the branch that begins with the test ``p`` holds the call."""
        after = test_end(p) + 1
        return tests(p) & (test_end(p) < s["at"]) & (block(after, s) | ((text(after) != "{") & inside(p, s) & straight(p, s)))

    def other(p: Column, s: Column) -> Column:
        after = p["at"] + 1
        return block(after, s) | (~text(after).isin("{", "if") & inside(p, s) & straight(p, s))

    def left(p: Column, s: Column) -> Column:
        """Whether the if ``p`` before the call returns."""
        after = test_end(p) + 1
        return tests(p) & inside(p, s) & (after < s["at"]) & ((text(after) == "return") | ((text(after) == "{") & (text(after + 1) == "return") & (token(after)["mate"] < s["at"])))

    def returned(a: Column, s: Column) -> Column:
        """Whether the call stands in a function that the hook returns."""
        first = F.when(a["text"] == "function", a["at"]).when(text(a["at"] - 1) == ")", token(a["at"] - 1)["mate"]).otherwise(a["at"] - 1)
        held = F.when(a["text"] == "=>", block(a["at"] + 1, s) | ((text(a["at"] + 1) != "{") & straight(a, s))).otherwise(straight(a, s))
        return a["text"].isin("=>", "function") & inside(a, s) & held & ((text(first - 1) == "return") | ((text(first - 1) == "async") & (text(first - 2) == "return")))

    def site(s: Column) -> Column:
        before, argument = text(s["at"] - 1), s["at"] + 2
        chained = before.isin("&&", "||", "??", "?") | ((before == ":") & F.exists(body, lambda x: (x["text"] == "?") & (x["at"] < s["at"]) & (x["region"] == s["region"])))
        start = F.coalesce(F.array_max(F.transform(F.filter(body, lambda x: (x["at"] < s["at"] - 1) & (x["region"] == s["region"]) & x["text"].isin(";", "{", "}", "=>")), lambda x: x["at"])), s["region"]) + 1
        ands = F.when(before == "&&", F.array(joined(F.greatest(start, base), s["at"] - 2))).otherwise(F.array().cast("array<string>"))
        conditions = F.transform(F.filter(body, lambda p: (p["text"] == "if") & under(p, s)), lambda p: joined(p["at"] + 2, test_end(p) - 1))
        exits = F.transform(F.filter(body, lambda p: (p["text"] == "if") & left(p, s)), lambda p: joined(p["at"] + 2, test_end(p) - 1))
        return _struct(
            deferred=F.exists(body, lambda r: (r["text"] == "(") & (r["at"] < s["at"]) & (r["mate"] > s["at"]) & text(r["at"] - 1).isin(DEFERRING)),
            cleanup=F.exists(body, lambda a: returned(a, s)),
            conditional=chained | F.exists(body, lambda p: (p["text"].isin(_BRANCHING) & under(p, s)) | ((p["text"] == "else") & other(p, s)) | ((p["text"] == "if") & left(p, s))),
            functional=(text(argument) == "function") | (text(argument + 1) == "=>") | ((text(argument) == "(") & (text(token(argument)["mate"] + 1) == "=>")),
            conditions=F.concat(conditions, ands), exits=exits, argument=joined(argument, token(s["at"] + 1)["mate"] - 1),
        )

    calls = F.filter(body, lambda t: (t["text"] == setter) & (text(t["at"] + 1) == "(") & (text(t["at"] - 1) != "."))
    return F.transform(calls, site)


def _guard(state: Column) -> Column:
    """What the conditions of the row's ``sites`` mean for ``state``: safe if they end a loop after one turn, spread if a test of
    one property is followed by a new object, which ends none; null otherwise."""
    name = F.regexp_replace(state, r"\$", r"\\\$")
    matches = lambda x, *parts: F.regexp_like(x, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))

    def kind(site: Column, test: Column) -> Column:
        flipped = (test == F.concat(F.lit("! "), state)) & ~site["argument"].isin("") & (site["argument"] != state)
        dropped = (test == state) & site["argument"].isin("false", "null", "undefined")
        member = matches(test, r"^", name, r" (\.|\?\.) [\w$]+( (\.|\?\.) [\w$]+)* !==? ") | matches(test, r" !==? ", name, r" (\.|\?\.) [\w$]+( (\.|\?\.) [\w$]+)*$")
        unequal = matches(test, r"^", name, r" !==? ") | matches(test, r" !==? ", name, "$")
        spread = matches(site["argument"], r"^\{.*\.\.\. ", name, r"\b")
        return F.when(flipped | dropped | unequal, "safe").when(member, F.when(spread, "spread").otherwise("safe"))

    def exit_kind(test: Column) -> Column:
        return F.when((test == state) | matches(test, r"^", name, r" ===? ") | matches(test, r" ===? ", name, "$"), "safe")

    def of(site: Column) -> Column:
        parts = F.flatten(F.transform(site["conditions"], lambda c: F.split(c, " && ")))
        return F.concat(F.transform(parts, lambda t: kind(site, t)), F.transform(site["exits"], exit_kind))

    return F.array_min(F.flatten(F.transform(F.filter("sites", lambda s: ~s["deferred"] & ~s["cleanup"]), of)))


def hook_findings(files: DataFrame, marker: str = "loop-ignore", trust_guards: bool = False) -> DataFrame:
    """(path, line, hook, dependency, setter, type, code, severity, confidence).

    Contents are scanned once and neither they nor tokens are shuffled: every dependency that is a state meets the calls of
    its setter inside the row. With ``trust_guards`` tests that end a loop after one turn make a call safe, and tests of one
    property before a new object are told apart; otherwise any condition is a potential issue.
    """
    calls = facts.hook_calls(files).where(~F.array_contains(facts.silent_lines(F.col("content"), marker), F.col("line")))
    effect = F.col("hook").isin(facts.EFFECT_HOOKS)
    place = ["line", "hook", "at"]
    setter_of = lambda d: F.get(F.filter("pairs", lambda p: p["state"] == d), F.lit(0))["setter"]
    listed = F.transform("deps", lambda d: _struct(setter=setter_of(d), state=d))
    bare = F.when(effect & (F.col("n_args") == 1), F.array_sort(F.transform("pairs", lambda p: _struct(setter=p["setter"], state=p["state"]))))
    called = lambda c: F.exists("body", lambda t: (t["text"] == c["setter"]) & (F.get("body", t["at"] - F.col("body")[0]["at"] + 1)["text"] == "("))
    tried = calls.select("files", *place, "body", F.col("deps").isNull().alias("bare"), F.posexplode(F.filter(F.coalesce(listed, bare), called)).alias("dep_pos", "c"))
    deps = tried.select("files", *place, "bare", "dep_pos", F.col("c.state").alias("dependency"), F.col("c.setter").alias("setter"), setter_sites("body", F.col("c.setter")).alias("sites"))
    some = lambda *flags: F.exists("sites", lambda s: reduce(lambda a, b: a & b, [~s[f[1:]] if f[0] == "!" else s[f] for f in flags]))
    guard = _guard(F.col("dependency")) if trust_guards else F.lit(None).cast("string")
    action = (
        F.when(F.size("sites") == 0, None)
        .when(F.col("bare"), "no-deps")
        .when(guard.isNotNull(), guard)
        .when(some("deferred"), "safe")
        .when(effect & some("cleanup"), "loop")
        .when(effect & some("!deferred", "!cleanup", "!conditional"), "loop")
        .when(effect & some("!deferred", "!cleanup"), "guarded")
        .when(~effect & some("functional"), "stop")
        .when(~effect & some("!deferred"), "memo")
    )
    # judged by content; every file that has it gets the rows
    judged = by_file(deps.select("files", *place, "dep_pos", "dependency", "setter", action.alias("action"))).withColumn("idle", F.col("action").isNull())
    # rows are dropped behind the aggregation only: a filter before it would be moved down and work out all sites again
    found = rel.first_of(judged, ["path", *place], ["idle", "dep_pos"]).where("action is not null and action != 'stop'")
    value = lambda k: F.coalesce(*(F.when(F.col("action") == a, F.lit(v[k])) for a, v in ACTIONS.items()))
    return found.select("path", "line", "hook", "dependency", "setter", value(0).alias("type"), value(1).alias("code"), value(2).alias("severity"), value(3).alias("confidence"))


def import_cycles(files: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle): import cycles, of up to ``longest`` files if given, each once, from its first path on."""
    return graph.simple_cycles(facts.module_edges(facts.imports(files), files), longest)


def mutual_contexts(files: DataFrame) -> DataFrame:
    """(a, b): files that import each other where one of them creates a context."""
    both = graph.mutual_edges(facts.module_edges(facts.imports(files), files))
    makes = files.where(F.col("content").rlike(r"\bcreateContext\b")).select("path").distinct()
    at = lambda end: both.join(makes.withColumnRenamed("path", end), end, "left_semi")
    return at("a").unionByName(at("b")).distinct()


def call_cycles(files: DataFrame) -> DataFrame:
    """(src, dst, calls): imports of functions that the imported file exports, where that file imports the importing one."""
    edges = facts.module_edges(facts.imports(files), files)
    named = edges.select("src", "dst", F.explode("names").alias("name"))
    known = facts.exports(files).select(F.col("path").alias("dst"), "name").distinct()
    calls = named.join(known, ["dst", "name"]).groupBy("src", "dst").agg(F.array_sort(F.collect_set("name")).alias("calls"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return calls.join(back, ["src", "dst"], "left_semi")


def cross_file_cycles(files: DataFrame) -> DataFrame:
    """(kind, a, b): context and call cycles of two files, each pair once by kind."""
    calls = call_cycles(files).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return mutual_contexts(files).select(F.lit("context").alias("kind"), "a", "b").union(calls.select(F.lit("call").alias("kind"), "a", "b"))


def document_diagnostics(findings: DataFrame, cycles: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, kind, line, code): findings of each document of ``documents(path)``, and the import cycles it takes part in.

    Paths meet in one form: without a scheme, with slashes, in small letters. ``findings(path, line, code)``,
    ``cycles(cycle)``; a cycle is shown on line 1.
    """
    same = lambda c: F.lower(F.replace(F.regexp_replace(c, "^file:(//)?", ""), F.lit("\\"), F.lit("/")))
    shown = documents.select("path", same(F.col("path")).alias("_at")).distinct()
    own = findings.select(same(F.col("path")).alias("_at"), F.lit("finding").alias("kind"), "line", "code")
    shared = cycles.select(F.explode(F.array_distinct("cycle")).alias("_p")).select(same(F.col("_p")).alias("_at"), F.lit("cycle").alias("kind"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("code"))
    return shown.join(own.unionByName(shared), "_at").select("path", "kind", "line", "code")


def confidence_text(confidence: Column, inferred: Column, strict: Column, depth: Column, conditional: Column) -> Column:
    """Why a finding's confidence is what it is; empty without a reason. Null flags count as false."""
    reasons = F.array_compact(F.array(
        F.when(inferred & ~F.coalesce(strict, F.lit(False)), "type information is inferred (enable --strict for higher accuracy)"),
        F.when(depth > 2, F.concat(F.lit("involves a "), depth.cast("string"), F.lit("-level cross-file dependency chain"))),
        F.when(conditional, "the setState is inside a conditional block"),
    ))
    return F.when(F.size(reasons) > 0, F.concat(F.lit(" Confidence is "), confidence, F.lit(" because "), F.array_join(reasons, ", "), F.lit("."))).otherwise(F.lit(""))
