"""Queries that run the source analysis on code made from the plain tables, and further generic operators, beside their SQL.

The tables hold no source code, so files are written from rows: each nation is a module that imports others, each order a
component whose effect depends on the order's priority. The SQL states what must be found from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import lookups, pattern_index
from quillmesh.operators import flow, graph, relational as rel, resolution as res
from quillmesh.plans import code_rules
from quillmesh.plans.code_rules import confidence_text, cross_file_cycles, hook_findings
from quillmesh.plans.table_queries import _edges, _LEVEL, table, trade
from quillmesh.sources import code_facts as facts, config_documents as config, module_paths
from quillmesh.streaming import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


#: Files that one task reads, roughly.
TOGETHER = 100_000


def spread(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table in as many partitions as there are cores at least, and no partition with many more rows than
    ``TOGETHER``: a small file becomes many source files."""
    rows = table(spark, d, name).select(*columns)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TOGETHER))
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def modules(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a module for each nation with a renamed, a namespace and an aliased import."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    body = _text(
        "import { f", (k * 7 + 1) % 25, " as near } from './n", (k * 7 + 1) % 25, "';\n// next\nimport * as all from '../r", (k * 3) % 5, "/n", (k + 5) % 25, "';\n",
        "import far from '@r", r, "/n", (k * k + 5) % 25, "';\nexport const f", k, " = () => near;\nexport default function main() {}\n",
    )
    return table(spark, d, "nation").select(_text("/world/r", r, "/n", k, ".ts").alias("path"), body.alias("content"))


_PATH = "'/world/r' || {0}.n_regionkey || '/n' || {0}.n_nationkey || '.ts'"
_IMPORTS = f"""imports AS (SELECT {_PATH.format("a")} AS src, {_PATH.format("b")} AS dst, 1 AS line FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 1) % 25 AND b.n_regionkey = a.n_regionkey
UNION ALL SELECT {_PATH.format("a")}, {_PATH.format("b")}, 3 FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25 AND b.n_regionkey = (a.n_nationkey * 3) % 5)"""


@query(f"WITH {_IMPORTS} SELECT src, dst, line FROM imports")
def import_edges(spark, d):
    files = modules(spark, d)
    return facts.module_edges(facts.imports(files), files).select("src", "dst", "line")


@query(f"""WITH RECURSIVE {_IMPORTS}, e AS (SELECT DISTINCT src, dst FROM imports), paths AS (SELECT src AS head, [src] AS path, src AS last FROM e
  UNION SELECT head, list_append(path, dst), dst FROM paths JOIN e ON last = src WHERE dst > head AND NOT list_contains(path, dst))
SELECT DISTINCT array_to_string(path, ' > ') AS cycle FROM paths JOIN e ON last = src AND dst = head""")
def import_cycle_paths(spark, d):
    files = modules(spark, d)
    return graph.simple_cycles(facts.module_edges(facts.imports(files), files)).select(F.array_join("cycle", " > ").alias("cycle"))


@query(f"""WITH RECURSIVE {_IMPORTS}, reach AS (SELECT {_PATH.format("nation")} AS path FROM nation WHERE n_regionkey = 0 UNION SELECT dst FROM reach JOIN imports ON path = src) SELECT path FROM reach""")
def imported_closure(spark, d):
    files = modules(spark, d)
    return facts.expanded(files, files.where("path like '/world/r0/%'").select("path"))


@query(f"SELECT {_PATH.format('a')} AS src, {_PATH.format('b')} AS dst FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * a.n_nationkey + 5) % 25 AND b.n_regionkey = a.n_regionkey")
def alias_edges(spark, d):
    files = modules(spark, d)
    aliases = table(spark, d, "region").select(_text("@r", F.col("r_regionkey")).alias("alias"), F.explode(F.array(F.struct(_text("/lost/r", F.col("r_regionkey")).alias("target"), F.lit(0).alias("ord")), F.struct(_text("/world/r", F.col("r_regionkey")).alias("target"), F.lit(1).alias("ord")))).alias("t")).select("alias", "t.target", "t.ord")
    return facts.aliased_edges(facts.imports(files, relative=False), files, aliases).select("src", "dst")


@query(f"""SELECT {_PATH.format("nation")} AS path, 'near' AS local, 'f' || (n_nationkey * 7 + 1) % 25 AS imported FROM nation""")
def import_renames(spark, d):
    return facts.renamed_imports(modules(spark, d))


@query(f"""SELECT {_PATH.format("nation")} AS path, name, is_default, line::INTEGER AS line FROM (SELECT n_nationkey, n_regionkey, 'f' || n_nationkey AS name, false AS is_default, 5 AS line FROM nation
UNION ALL SELECT n_nationkey, n_regionkey, 'main', true, 6 FROM nation) nation""")
def module_exports(spark, d):
    return facts.exports(modules(spark, d)).select("path", "name", "is_default", "line")


#: Priority, call in the component, and the line and code of its finding.
_EFFECTS = [
    ("1-URGENT", "useEffect(() => { setTally(tally + 1); }, [tally]);", 200),
    ("2-HIGH", "useEffect(() => { if (tally < 9) setTally(tally + 1); }, [tally]);", 501),
    ("3-MEDIUM", "useEffect(() => { setTally(1); });", 201),
    ("4-NOT SPECIFIED", "const go = useCallback(() => { setTally(tally + 1); }, [tally]);", 420),
    ("5-LOW", "useEffect(() => { log(tally); }, [tally]);", None),
]


def components(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a component for each order; an ignore comment precedes the effect of pending orders."""
    call = F.coalesce(*(F.when(F.col("o_orderpriority") == p, F.lit(c)) for p, c, _ in _EFFECTS))
    skip = F.when(F.col("o_orderstatus") == "P", F.lit("  // loop-ignore-next-line")).otherwise(F.lit(""))
    body = _text("import { useState, useEffect } from 'react';\nexport const View = () => {\n  const [tally, setTally] = useState(0);\n", skip, "\n  ", call, "\n};\n")
    return spread(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(_text("/app/o", F.col("o_orderkey"), ".tsx").alias("path"), body.alias("content"))


_CODES = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {c}" for p, _, c in _EFFECTS if c) + " END"


@query(f"SELECT * FROM (SELECT '/app/o' || o_orderkey || '.tsx' AS path, 5 AS line, {_CODES} AS code FROM orders WHERE o_orderstatus <> 'P') WHERE code IS NOT NULL")
def effect_findings(spark, d):
    return hook_findings(components(spark, d)).select("path", "line", "code")


#: Lines of a component from its hook on, with S for the state and T for its setter; the hook's line among them, its name, its
#: dependencies, and the code of its finding with plain conditions and with trusted guards.
_SHAPES = [
    ("useEffect(() => T(1), [S]);", 0, "useEffect", "S", 200, 200),
    ("useEffect(() => T(1), [other]);", 0, "useEffect", "other", None, None),
    ("useEffect(() => { T(1); }, [S[0], S.size]);", 0, "useEffect", "S,S", 200, 200),
    ("// useEffect(() => { T(1); }, [S]);\nuseMemo(() => S + 1, [S]);", 1, "useMemo", "S", None, None),
    ("useEffect(() => { log(1); });\nT(3);", 0, "useEffect", None, None, None),
    ("useEffect(() => { log('T(', `${S}`); }, [S]);", 0, "useEffect", "S", None, None),
    ("useEffect(\n  () => {\n    const a = { b: { c: [1] } };\n    T({ ...a });\n  },\n  [other, S],\n);", 0, "useEffect", "other,S", 200, 200),
    ("useLayoutEffect(() => T(1));", 0, "useLayoutEffect", None, 201, 201),
    ("useEffect(() => { const t = setTimeout(() => T(S + 1), 5); return () => clearTimeout(t); }, [S]);", 0, "useEffect", "S", 200, 200),
    ("useEffect(() => {\n  log(1);\n  return () => { T(0); };\n}, [S]);", 0, "useEffect", "S", 200, 200),
    ("useEffect(() => { if (S < 3) T(S + 1); }, [S]);", 0, "useEffect", "S", 501, 501),
    ("useEffect(() => { if (S !== 3) { T(3); } }, [S]);", 0, "useEffect", "S", 501, 200),
    ("log(2);\nuseEffect(() => { if (S.id !== 5) T({ ...S, id: 5 }); }, [S.id]);", 1, "useEffect", "S", 501, 410),
    ("useCallback(() => { T(S + 1); }, [S]);", 0, "useCallback", "S", 420, 420),
    ("useCallback(() => { T((n) => n + 1); }, [S]);", 0, "useCallback", "S", None, None),
    ("/* loop-ignore-next-line */\nuseEffect(() => T(1), [S]);", 1, "useEffect", "S", None, None),
]
_NAMES = ["mood", "rows", "total", "draft", "seen"]


def varied(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a component for each order, of a shape, state name and first line by its key."""
    k, n = F.col("o_orderkey"), len(_SHAPES)
    pick = lambda of, values: F.element_at(F.array(*(F.lit(v) for v in values)), (of + 1).cast("int"))
    name = pick(k % len(_NAMES), _NAMES)
    setter = F.concat(F.lit("set"), F.initcap(name))
    shape = F.replace(F.regexp_replace(pick(F.floor(k / 4) % n, [s[0] for s in _SHAPES]), r"\bT\(", "@("), F.lit("S"), name)
    body = _text("import { useState } from 'react';\n", F.repeat(F.lit("// note (\n"), (k % 3).cast("int")), "export function View() {\nconst [", name, ", ", setter, "] = useState<A>(make());\n", F.replace(shape, F.lit("@("), F.concat(setter, F.lit("("))), "\n}\n")
    return spread(spark, d, "orders", "o_orderkey").select(_text("/app/v", k, ".tsx").alias("path"), body.alias("content"))


def _by_shape(at: int, case=lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else v) -> str:
    return "CASE o_orderkey // 4 % " + f"{len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {case(s[at])}" for i, s in enumerate(_SHAPES)) + " END"


_STATE = f"list_extract({_NAMES}, (o_orderkey % {len(_NAMES)} + 1)::INTEGER)"
_VARIED = f"SELECT '/app/v' || o_orderkey || '.tsx' AS path, (o_orderkey % 3 + 4 + {_by_shape(1)})::INTEGER AS line, {_by_shape(2)} AS hook"


@query(f"{_VARIED}, replace({_by_shape(3)}, 'S', {_STATE}) AS deps FROM orders")
def varied_hooks(spark, d):
    return facts.hooks(varied(spark, d)).select("path", "line", "hook", F.array_join("deps", ",").alias("deps"))


@query(f"SELECT * FROM ({_VARIED}, {_STATE} AS dependency, {_by_shape(4)} AS code FROM orders) WHERE code IS NOT NULL")
def varied_findings(spark, d):
    return hook_findings(varied(spark, d)).select("path", "line", "hook", "dependency", "code")


@query(f"SELECT * FROM ({_VARIED}, {_STATE} AS dependency, {_by_shape(5)} AS code FROM orders) WHERE code IS NOT NULL")
def trusted_findings(spark, d):
    return hook_findings(varied(spark, d), trust_guards=True).select("path", "line", "hook", "dependency", "code")


@query(f"SELECT '/app/v' || o_orderkey || '.tsx' AS path, {_STATE} AS state, 'set' || upper({_STATE}[1]) || {_STATE}[2:] AS setter FROM orders")
def varied_states(spark, d):
    return facts.state_pairs(varied(spark, d))


@query("SELECT '/app/o' || o_orderkey || '.tsx' AS path, 'tally' AS state, 'setTally' AS setter FROM orders")
def state_setters(spark, d):
    return facts.state_pairs(components(spark, d))


@query("""SELECT '/app/o' || o_orderkey || '.tsx' AS path, 5 AS line, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'useCallback' ELSE 'useEffect' END AS hook, CASE o_orderpriority WHEN '3-MEDIUM' THEN NULL ELSE 'tally' END AS deps FROM orders""")
def hook_rows(spark, d):
    return facts.hooks(components(spark, d)).select("path", "line", "hook", F.array_join("deps", ",").alias("deps"))


@query("SELECT '/app/o' || o_orderkey || '.tsx' AS path, 5 AS line FROM orders WHERE o_orderstatus = 'P'")
def silenced_lines(spark, d):
    return facts.ignored_lines(components(spark, d))


@query("SELECT '/app/o' || o_orderkey || '.tsx' AS path FROM orders")
def react_files(spark, d):
    return facts.likely_react(components(spark, d).union(modules(spark, d))).select("path")


@query("""WITH p AS (SELECT '/ctx/n' || a.n_nationkey || '.ts' AS a, '/ctx/n' || b.n_nationkey || '.ts' AS b, a.n_nationkey % 3 = 0 OR b.n_nationkey % 3 = 0 AS context, a.n_nationkey % 4 = 0 OR b.n_nationkey % 4 = 0 AS call
  FROM nation a JOIN nation b ON a.n_nationkey % 2 = 0 AND b.n_nationkey = a.n_nationkey + 1)
SELECT 'context' AS kind, a, b FROM p WHERE context UNION ALL SELECT 'call', a, b FROM p WHERE call""")
def file_cycles(spark, d):
    """Neighbouring nations import each other; every third makes a context, every fourth exports what its neighbour imports."""
    k = F.col("n_nationkey")
    other, export = k + 1 - 2 * (k % 2), F.when(k % 4 == 0, _text("export function f", k, "() {}\n")).otherwise(F.lit(""))
    body = _text("import { f", other, " } from './n", other, "';\n", export, F.when(k % 3 == 0, F.lit("export const C = createContext(null);\n")).otherwise(F.lit("")))
    return cross_file_cycles(table(spark, d, "nation").select(_text("/ctx/n", k, ".ts").alias("path"), body.alias("content")))


@query(f"""WITH RECURSIVE {_edges(2)}, own AS (SELECT n_nationkey AS node, 'set' || r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0),
flow AS (SELECT node, value FROM own UNION SELECT e.src, f.value FROM flow f JOIN edges e ON e.dst = f.node)
SELECT s_suppkey, coalesce(string_agg(value, ',' ORDER BY value), '') AS setters FROM supplier LEFT JOIN flow ON node = s_nationkey GROUP BY s_suppkey""")
def setter_flow(spark, d):
    """Which setters the function that each supplier's effect calls reaches, directly or through the functions it calls."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    own = n.where("n_nationkey % 3 = 0").join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("node"), F.concat(F.lit("set"), "r_name").alias("value"))
    flow = graph.propagated(trade(spark, d, 2), own).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("setters"))
    s = table(spark, d, "supplier")
    return s.join(flow, s.s_nationkey == flow.node, "left").select("s_suppkey", F.coalesce("setters", F.lit("")).alias("setters"))


_PAGES = "p AS (SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"


@query(f"""WITH {_PAGES}, known AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM p WHERE path LIKE '%.html' UNION SELECT '/' || split_part(path, '/', 2) FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, arg_max(dir, length(dir)) AS nearest FROM p LEFT JOIN known ON starts_with(path, dir || '/') GROUP BY page_id""")
def governing_folder(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "://([^?#]*)", 1)).alias("path"))
    with_page = p.where("path like '%.html'").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    hosts = p.groupBy(F.concat(F.lit("/"), F.split("path", "/")[1]).alias("dir")).agg(F.count("*").alias("n")).where("n > 1").select("dir")
    return res.nearest_ancestor(p, "page_id", "path", with_page.union(hosts).distinct(), "dir")


@query("""SELECT * FROM (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS change
FROM (SELECT p_partkey AS k, md5(p_name) AS h FROM part WHERE p_size <> 2) o FULL JOIN (SELECT p_partkey AS k, md5(CASE WHEN p_size > 40 THEN p_name || '!' ELSE p_name END) AS h FROM part WHERE p_size <> 1) n ON o.k = n.k) WHERE change IS NOT NULL""")
def manifest_diff(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "k")
    old = part.where("p_size != 2").select("k", F.md5("p_name").alias("h"))
    return res.manifest_changes(old, part.where("p_size != 1").select("k", F.md5(F.expr("if(p_size > 40, p_name || '!', p_name)")).alias("h")), "k", "h")


@query("""SELECT a.p_brand, a.last, b.types FROM (SELECT p_brand, arg_max(p_type, p_size * 10000000 + p_partkey) AS last FROM part GROUP BY ALL) a JOIN
(SELECT p_brand, string_agg(p_type, ',' ORDER BY f) AS types FROM (SELECT p_brand, p_type, min(p_size * 10000000 + p_partkey) AS f FROM part GROUP BY ALL) GROUP BY ALL) b USING (p_brand)""")
def settings_merge(spark, d):
    """Settings by layer: a later layer overrides a value and adds to a list."""
    part = table(spark, d, "part")
    last = res.merged_scalars(part, "p_brand", "p_type", ["p_size", "p_partkey"]).withColumnRenamed("p_type", "last")
    return last.join(res.merged_lists(part, "p_brand", "p_type", ["p_size", "p_partkey"]), "p_brand").select("p_brand", "last", F.array_join("values", ",").alias("types"))


@query("""SELECT c_custkey FROM customer WHERE c_nationkey <> 3 AND c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def unstable_minus(spark, d):
    c = table(spark, d, "customer")
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return res.minus(c, "c_custkey", c.where("c_nationkey = 3"), c.where("c_acctbal < 0"), pending).select("c_custkey")


@query("""SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY ALL) r USING (user_id) WHERE last IS NULL OR e.event_id > last""")
def since_reset(spark, d):
    return res.since_reset(table(spark, d, "events"), "user_id", "event_id", "event_type = 'purchase'").select("event_id")


@query("""SELECT tier, key, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY tier, key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY tier, key ORDER BY ts, event_id) + (CASE tier WHEN 1 THEN INTERVAL 6 HOUR ELSE INTERVAL 1 HOUR END) THEN 0 ELSE 1 END AS fresh
  FROM (SELECT 1 AS tier, user_id::VARCHAR AS key, ts, event_id FROM events UNION ALL SELECT 2, (user_id % 10)::VARCHAR, ts, event_id FROM events))) GROUP BY tier, key, burst""")
def two_tier_bursts(spark, d):
    ev = table(spark, d, "events").withColumn("project", F.col("user_id") % 10)
    return rel.two_tier(ev, "user_id", "project", "ts", "6 hours", "1 hours")


_BANDS = "SELECT o_orderpriority AS p, min(o_totalprice) / 1000 AS lo, avg(o_totalprice) / 1000 AS hi FROM orders GROUP BY ALL"


@query(f"SELECT event_id, p FROM (SELECT event_id, p, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, p) AS rn FROM events JOIN ({_BANDS}) ON value BETWEEN lo AND hi) WHERE rn = 1")
def innermost_band(spark, d):
    bands = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg((F.min("o_totalprice") / 1000).alias("lo"), (F.avg("o_totalprice") / 1000).alias("hi")).withColumn("size", F.col("hi") - F.col("lo"))
    return rel.interval_lookup(table(spark, d, "events"), bands, [], "value", "lo", "hi", ["size", "p"], ["event_id"], width=10.0).select("event_id", "p")


@query(r"""SELECT name, regexp_matches(name, '^[A-Z][A-Z0-9_]*$') OR regexp_matches(name, '^-?[0-9.]+$') OR contains(name, '.') OR name IN ('true', 'null') AS plain, regexp_matches(name, '^[A-Z]') AS component
FROM (SELECT DISTINCT unnest([c_mktsegment, c_name, c_nationkey::VARCHAR, 'obj.' || c_nationkey, 'true', 'local' || c_nationkey]) AS name FROM customer)""")
def name_kinds(spark, d):
    names = F.explode(F.array("c_mktsegment", "c_name", F.col("c_nationkey").cast("string"), _text("obj.", F.col("c_nationkey")), F.lit("true"), _text("local", F.col("c_nationkey")))).alias("name")
    return table(spark, d, "customer").select(names).distinct().select("name", lookups.plain_name(F.col("name")).alias("plain"), lookups.component_name(F.col("name")).alias("component"))


@query(f"""SELECT o_orderkey, '{{"ruleId":"' || o_orderstatus || '","level":"' || {_LEVEL} || '","message":{{"text":"' || o_orderpriority || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"/app/o' || o_orderkey || '.tsx"}},"region":{{"startLine":' || o_orderkey || '}}}}}}]}}' AS json FROM orders""")
def sarif_results(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", sinks.sarif_result(F.col("o_orderstatus"), sinks.sarif_level(F.col("o_orderpriority"), "1-URGENT", "2-HIGH"), F.col("o_orderpriority"), _text("/app/o", F.col("o_orderkey"), ".tsx"), F.col("o_orderkey")).alias("json"))


@query("""SELECT '{"driver":{"name":"quillmesh","rules":[' || string_agg('{"id":"' || r_regionkey || '","shortDescription":{"text":"' || r_name || '"}}', ',' ORDER BY r_regionkey) || ']}}' AS json FROM region""")
def sarif_rules(spark, d):
    return sinks.sarif_head(table(spark, d, "region").withColumn("id", F.col("r_regionkey").cast("string")), "id", "r_name")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_report(spark, d):
    return sinks.json_rows(table(spark, d, "nation"), "n_nationkey")


@query("""WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
SELECT a.doc_id, a.line_no AS hit_line, b.line_no, b.line FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2 WHERE regexp_matches(a.line, 'license|License')""")
def code_frames(spark, d):
    f = sinks.code_frames(table(spark, d, "documents"), "doc_id", "text", "license|License")
    return f.select("doc_id", F.col("hit_line").cast("long").alias("hit_line"), F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {_edges(2)} SELECT '  "' || src || '" -> "' || dst || '" [label="' || n || '"];' AS line FROM edges""")
def dot_graph(spark, d):
    return sinks.dot_lines(trade(spark, d, 2), "src", "dst", "n")


#: Parts in blocks of 50, each a graph of its own: every part leads to one by a square, some to the next as well.
_BLOCKS = """e AS (SELECT p_partkey AS src, p_partkey // 50 * 50 + ((p_partkey % 50) * (p_partkey % 50) + 1 + p_partkey // 50) % 50 AS dst FROM part
UNION SELECT p_partkey, p_partkey // 50 * 50 + (p_partkey % 50 + 1) % 50 FROM part WHERE p_partkey % 10 < 4)"""


@query(f"""WITH RECURSIVE {_BLOCKS}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
SELECT n.node, least(n.node, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = n.node AND b.src = a.dst AND b.dst = n.node), n.node)) AS part FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n""")
def strong_parts(spark, d):
    p = F.col("p_partkey")
    part, block, at = table(spark, d, "part"), F.floor(p / 50).cast("bigint"), p % 50
    e = part.select(p.alias("src"), (block * 50 + (at * at + 1 + block) % 50).alias("dst"))
    return graph.strong_parts(e.union(part.where("p_partkey % 10 < 4").select("p_partkey", block * 50 + (at + 1) % 50)))


@query("""WITH RECURSIVE p AS (SELECT p_partkey // 25 AS g, p_partkey % 25 AS i FROM part), m AS (SELECT g, min(i) AS root, max(i) AS exit FROM p GROUP BY g),
e AS (SELECT g, i AS src, i + 1 AS dst FROM p UNION SELECT g, i, i + 2 FROM p WHERE (i * i + g) % 3 = 0 UNION SELECT g, i, i - 3 FROM p WHERE i % 7 = 6), f AS (SELECT g, src, dst FROM e JOIN p ON p.g = e.g AND p.i = e.dst),
walk AS (SELECT p.g, p.i AS out, root AS node FROM p JOIN m USING (g) WHERE p.i <> root UNION SELECT w.g, w.out, f.dst FROM walk w JOIN f ON f.g = w.g AND f.src = w.node AND f.dst <> w.out)
SELECT p.g AS graph, p.i AS node FROM p JOIN m USING (g) WHERE p.i = root OR p.i = exit OR NOT EXISTS (SELECT 1 FROM walk w WHERE w.g = p.g AND w.out = p.i AND w.node = m.exit)""".replace("SELECT g, src, dst FROM e JOIN p ON", "SELECT e.g, src, dst FROM e JOIN p ON"))
def guaranteed_nodes(spark, d):
    """In graphs of 25 parts, which every way from the first to the last part passes."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 25).cast("bigint").alias("graph"), (F.col("p_partkey") % 25).alias("i"))
    step = lambda rows, by: rows.select("graph", F.col("i").alias("src"), (F.col("i") + by).alias("dst"))
    e = step(p, 1).union(step(p.where("(i * i + graph) % 3 = 0"), 2)).union(step(p.where("i % 7 = 6"), -3)).distinct()
    e = e.join(p.withColumnRenamed("i", "dst"), ["graph", "dst"], "left_semi")
    ends = p.groupBy("graph").agg(F.min("i").alias("root"), F.max("i").alias("exit"))
    tree = graph.dominator_tree(e, ends.select("graph", F.col("root").alias("node")))
    return graph.guaranteed(tree, ends.select("graph", F.col("exit").alias("node")))


@query("""WITH RECURSIVE fn AS (SELECT 'f' || n_nationkey % 15 AS name, n_regionkey AS file, n_nationkey % 4 = 0 AS exported, n_nationkey AS ord, list_filter(['set' || n_regionkey, 'put' || n_nationkey % 5], lambda x: n_nationkey % 3 = 0 OR x[1] = 'p' AND n_nationkey % 5 = 1) AS setters FROM nation),
one AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY name ORDER BY exported DESC, CASE WHEN exported THEN -ord ELSE ord END) = 1),
inner_ AS (SELECT name, k, 'f' || ((ord * (2 * k + 1) + 1 + 3 * k) % 15) AS callee FROM one, (VALUES (0), (1)) t(k)),
steps AS (SELECT i.* FROM inner_ i JOIN one o ON o.name = i.callee),
ways AS (SELECT name AS src, name AS dst, [name] AS seen, []::INTEGER[] AS path FROM one UNION ALL SELECT w.src, s.callee, list_append(seen, s.callee), list_append(path, s.k + 1) FROM ways w JOIN steps s ON s.name = w.dst WHERE NOT list_contains(seen, s.callee)),
found AS (SELECT src, setter, min(list_concat(path, [0, pos])) AS place FROM (SELECT w.src, w.path, unnest(range(len(setters)))::INTEGER AS pos, unnest(setters) AS setter FROM ways w JOIN one o ON o.name = w.dst) GROUP BY ALL),
lists AS (SELECT src, string_agg(setter, ',' ORDER BY place) AS setters FROM found GROUP BY src)
SELECT c_custkey // 3 AS hook, max(c_custkey) AS call, arg_max(setters, c_custkey) AS setters FROM customer JOIN lists ON src = 'f' || c_custkey % 20 WHERE c_custkey % 4 > 0 GROUP BY ALL""")
def last_call_flow(spark, d):
    """Functions of few names, as nations; each third customer is a hook, its customers calls that pass up to three setters."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    setters = F.filter(F.array(_text("set", F.col("n_regionkey")), _text("put", k % 5)), lambda x: (k % 3 == 0) | ((F.substring(x, 1, 1) == "p") & (k % 5 == 1)))
    functions = n.select(_text("f", k % 15).alias("name"), F.col("n_regionkey").alias("file"), (k % 4 == 0).alias("exported"), k.alias("ord"), setters.alias("setters"))
    inner = functions.select("name", "file", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: F.concat(F.lit("f"), ((F.col("ord") * (2 * j + 1) + 1 + 3 * j) % 15).cast("string")))).alias("ord", "callee"))
    c = F.col("c_custkey")
    calls = table(spark, d, "customer").select(F.floor(c / 3).cast("bigint").alias("hook"), c.alias("ord"), _text("f", c % 20).alias("name"), (c % 4).alias("passes"))
    return flow.setter_flows(calls, functions, inner).select("hook", "call", F.array_join("setters", ",").alias("setters"))


_PATTERNS = """p AS (SELECT DISTINCT unnest(['^' || s_name || '$', 'er#0*' || s_suppkey || '$', '(1|2)' || s_nationkey || '$', 'Customer#0+' || s_nationkey || '[0-5]$', '^Customer.*' || s_suppkey % 97 || '.?$']) AS pattern FROM supplier),
n AS (SELECT DISTINCT unnest([c_name, c_mktsegment]) AS name FROM customer)"""


@query(f"WITH {_PATTERNS} SELECT name, pattern FROM n, p WHERE regexp_matches(name, pattern)")
def pattern_hits(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    made = F.array(_text("^", F.col("s_name"), "$"), _text("er#0*", k, "$"), _text("(1|2)", n, "$"), _text("Customer#0+", n, "[0-5]$"), _text("^Customer.*", k % 97, ".?$"))
    names = table(spark, d, "customer").select(F.explode(F.array("c_name", "c_mktsegment")).alias("name"))
    return pattern_index.pattern_hits(names, "name", table(spark, d, "supplier").select(F.explode(made).alias("pattern")))


@query(f"""WITH {_PATTERNS}, hit AS (SELECT name, CASE WHEN pattern LIKE '^%' THEN 'stable' ELSE 'unstable' END AS kind FROM n, p WHERE regexp_matches(name, pattern) UNION SELECT c_name, 'stable' FROM customer WHERE c_nationkey = 3)
SELECT n.name, count(*) FILTER (kind = 'stable') > 0 AS stable, count(*) FILTER (kind = 'unstable') > 0 AS unstable FROM n LEFT JOIN hit ON hit.name = n.name GROUP BY n.name""")
def judged_names(spark, d):
    n, k, c = F.col("s_nationkey"), F.col("s_suppkey"), table(spark, d, "customer")
    made = F.array(_text("^", F.col("s_name"), "$"), _text("er#0*", k, "$"), _text("(1|2)", n, "$"), _text("Customer#0+", n, "[0-5]$"), _text("^Customer.*", k % 97, ".?$"))
    rules = table(spark, d, "supplier").select(F.explode(made).alias("value")).select(F.expr("if(value like '^%', 'stable', 'unstable')").alias("kind"), "value", F.lit(True).alias("is_pattern"))
    rules = rules.union(c.where("c_nationkey = 3").select(F.lit("stable"), "c_name", F.lit(False)))
    return pattern_index.judged_names(c.select(F.explode(F.array("c_name", "c_mktsegment")).alias("name")), "name", rules)


_FOLDERS = ["packages", "apps", "libs", "kits", "mods/deep"]


def config_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a workspace for each nation, of a kind by its key, and a package for each of its suppliers."""
    k = F.col("n_nationkey")
    root = _text("/w/c", k)
    marks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("content")) for n, c in [
        ("nx.json", "{}"), ("turbo.json", "{ /* none */ }"), ("lerna.json", '{"packages": ["kits/*",],}'), ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\n"),
        ("package.json", '{"workspaces": {"packages": ["mods/**"]}}'), ("package.json", '{"name": "alone"}'),
    ]))
    more = lambda test, name, content: F.when(test, F.array(F.struct(F.lit(name).alias("name"), content.alias("content"))))
    extra = [more(k % 6 == 1, "lerna.json", F.lit('{"packages": ["kits/*"]}')), more(k % 2 == 0, "loops.json", _text('{"minSeverity": "high", "stableHooks": ["use', k, '"]}')), more(k % 3 != 0, "tsconfig.json", F.lit('{"include": ["packages/**/*"]}'))]
    none = F.array().cast("array<struct<name:string,content:string>>")
    roots = table(spark, d, "nation").select(root.alias("dir"), F.explode(F.concat(F.array(F.element_at(marks, (k % 6 + 1).cast("int"))), *(F.coalesce(x, none) for x in extra))).alias("f"))
    n, key = F.col("s_nationkey"), F.col("s_suppkey")
    manifest = _text('{"name": "pkg', key, '", "dependencies": {"lib', key % 7, '": "1.', key, '", "own', key % 3, '": "2"}, "devDependencies": {"lib', key % 4, '": "0.', key, '"}}')
    inner = F.concat(F.array(F.struct(F.lit("package.json").alias("name"), manifest.alias("content")), F.struct(F.lit("tsconfig.json").alias("name"), F.lit('{"references": [{"path": "./../../"}, {"path": "./build.json"}], "exclude": ["*.gen.ts"]}').alias("content"))), F.coalesce(more(key % 4 == 0, "loops.json", F.lit('{"ignore": ["x"], "strictMode": true} // own')), none))
    packages = table(spark, d, "supplier").select(_text("/w/c", n, "/", F.element_at(F.array(*map(F.lit, _FOLDERS)), (key % 5 + 1).cast("int")), "/s", key).alias("dir"), F.explode(inner).alias("f"))
    return roots.union(packages).select(F.concat("dir", F.lit("/"), "f.name").alias("path"), F.col("f.content").alias("content"))


_PACKAGE = f"p AS (SELECT s_suppkey AS s, s_nationkey AS n, s_suppkey % 5 AS f, '/w/c' || s_nationkey AS root, '/w/c' || s_nationkey || '/' || list_extract({_FOLDERS}, (s_suppkey % 5 + 1)::INTEGER) || '/s' || s_suppkey AS dir FROM supplier)"


@query(f"WITH {_PACKAGE} SELECT root, 'pkg' || s AS name, dir FROM p WHERE CASE n % 6 WHEN 0 THEN f < 3 WHEN 1 THEN f < 3 WHEN 2 THEN f = 3 WHEN 3 THEN f = 1 WHEN 4 THEN f = 4 ELSE false END")
def workspace_packages(spark, d):
    return config.workspace_packages(config_files(spark, d))


@query(f"WITH {_PACKAGE} SELECT dir || '/package.json' AS path, unnest(CASE WHEN s % 7 = s % 4 THEN ['lib' || s % 4, 'own' || s % 3] ELSE ['lib' || s % 4, 'own' || s % 3, 'lib' || s % 7] END) AS package, unnest(CASE WHEN s % 7 = s % 4 THEN ['0.' || s, '2'] ELSE ['0.' || s, '2', '1.' || s] END) AS version FROM p")
def manifest_dependencies(spark, d):
    return config.dependencies(config.documents(config_files(spark, d), ["package.json"]))


@query(f"""WITH {_PACKAGE} SELECT dir, CASE WHEN s % 4 <> 0 AND n % 2 = 0 THEN 'useBase,use' || n ELSE 'useBase' END AS stable, CASE WHEN s % 4 <> 0 AND n % 2 = 0 THEN 'high' ELSE 'low' END AS least, s % 4 = 0 AS strict, CASE WHEN s % 4 = 0 THEN 'x' ELSE '' END AS ignored FROM p""")
def layered_settings(spark, d):
    files = config_files(spark, d)
    starts = files.where("path like '%/s%/package.json'").select(config.folder(F.col("path")).alias("dir_"))
    got = config.layered_settings(starts, "dir_", config.documents(files, ["loops.json"]), {"stableHooks": ["useBase"], "minSeverity": "low", "strictMode": False})
    return got.select(F.col("dir_").alias("dir"), F.array_join("stableHooks", ",").alias("stable"), F.col("minSeverity").alias("least"), F.col("strictMode").alias("strict"), F.array_join("ignore", ",").alias("ignored"))


@query(f"""WITH {_PACKAGE} SELECT dir || '/tsconfig.json' AS src, CASE WHEN f = 4 THEN root || '/mods' WHEN n % 3 <> 0 THEN root || '/tsconfig.json' ELSE root END AS dst FROM p UNION ALL SELECT dir || '/tsconfig.json', dir || '/build.json' FROM p""")
def project_references(spark, d):
    return config.project_references(config_files(spark, d)).select("src", "dst")


@query(f"""WITH {_PACKAGE}, t AS (SELECT *, unnest(['/a.ts', '/b.gen.ts']) AS file FROM p)
SELECT dir || file AS path, CASE WHEN file = '/a.ts' THEN dir || '/tsconfig.json' WHEN f = 0 AND n % 3 <> 0 THEN root || '/tsconfig.json' END AS document FROM t""")
def governing_documents(spark, d):
    files = config_files(spark, d)
    sources = files.where("path like '%/s%/package.json'").select(F.explode(F.array(*(F.concat(config.folder(F.col("path")), F.lit(x)) for x in ("/a.ts", "/b.gen.ts")))).alias("path"))
    return config.governing_document(sources, files, "/w")


@query("""SELECT o_orderkey, CASE WHEN r = '' THEN '' ELSE ' Confidence is ' || lower(substr(o_orderpriority, 3)) || ' because ' || r || '.' END AS reason FROM (SELECT *, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN
'type information is inferred (enable --strict for higher accuracy)' END, CASE WHEN o_custkey % 5 > 2 THEN 'involves a ' || o_custkey % 5 || '-level cross-file dependency chain' END, CASE WHEN o_orderstatus = 'P' THEN 'the setState is inside a conditional block' END], lambda x: x IS NOT NULL), ', ') AS r FROM orders)""")
def confidence_texts(spark, d):
    k = F.col("o_orderkey")
    text = confidence_text(F.lower(F.expr("substring(o_orderpriority, 3)")), k % 2 == 0, k % 3 == 0, F.col("o_custkey") % 5, F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").select("o_orderkey", text.alias("reason"))


@query(f"""WITH RECURSIVE {_IMPORTS}, e AS (SELECT DISTINCT src, dst FROM imports), paths AS (SELECT src AS head, [src] AS path, src AS last FROM e
  UNION SELECT head, list_append(path, dst), dst FROM paths JOIN e ON last = src WHERE dst > head AND NOT list_contains(path, dst)), cycles AS (SELECT DISTINCT path FROM paths JOIN e ON last = src AND dst = head)
SELECT 'file://' || upper(p) AS path, 'cycle' AS kind, 1 AS line, NULL::INTEGER AS code FROM (SELECT unnest(path) AS p FROM cycles) UNION ALL
SELECT 'file:///APP/V' || o_orderkey || '.TSX', 'finding', (o_orderkey % 3 + 4 + {_by_shape(1)})::INTEGER, {_by_shape(4)} FROM orders WHERE {_by_shape(4)} IS NOT NULL AND o_orderkey % 2 = 0""")
def document_diagnostics(spark, d):
    """Documents as an editor names them: modules of nations, and every second component."""
    uri = lambda files: files.select(F.concat(F.lit("file://"), F.upper("path")).alias("path"))
    nations, parts = modules(spark, d), varied(spark, d)
    shown = uri(nations).union(uri(parts.where("cast(substring(path, 7, length(path) - 10) as bigint) % 2 = 0")))
    return code_rules.document_diagnostics(hook_findings(parts), code_rules.import_cycles(nations), shown)


@query("""WITH w AS (SELECT n_nationkey AS n, unnest(['./util', '../c' || (n_nationkey + 1) % 25 || '/src/main', '@own/util', 'gone/x']) AS source FROM nation)
SELECT '/w/c' || n || '/src/main.ts' AS path, source, CASE WHEN source = './util' OR source = '@own/util' AND n % 3 <> 0 THEN '/w/c' || n || '/src/util/index.tsx' END AS dst FROM w""")
def resolved_imports(spark, d):
    """Each nation's main file imports a folder by its index, a file that is not there, an alias of its project, and nothing."""
    k = F.col("n_nationkey")
    n, at = table(spark, d, "nation"), _text("/w/c", k)
    alias = n.where("n_nationkey % 3 != 0").select(F.concat(at, F.lit("/tsconfig.json")).alias("path"), F.lit('{"compilerOptions": {"baseUrl": "src", "paths": {"@own/*": ["lost/*", "./*"]}}}').alias("content"))
    sources = n.select(F.explode(F.array(F.concat(at, F.lit("/src/main.ts")), F.concat(at, F.lit("/src/util/index.tsx")))).alias("path"), F.lit("").alias("content"))
    wanted = n.select(F.concat(at, F.lit("/src/main.ts")).alias("path"), F.explode(F.array(F.lit("./util"), _text("../c", (k + 1) % 25, "/src/main"), F.lit("@own/util"), F.lit("gone/x"))).alias("source"))
    return module_paths.resolved_imports(wanted, alias.union(sources), "/w").select("path", "source", "dst")
