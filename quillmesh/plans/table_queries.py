"""Queries that run the generic operators on plain tables, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.lookups import stable_names
from quillmesh.operators import graph, relational as rel
from quillmesh.sources.imports import links_of
from quillmesh.streaming import sinks

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Edges from each customer nation to the nations of most of its suppliers."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # few distinct (order, nation) rows are left for the joins with orders and customers
    sold = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    pairs = sold.join(o, sold.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return graph.top_edges(pairs, "c_nationkey", "s_nationkey", k, "n")


def _edges(k: int) -> str:
    return f"""pairs AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rn FROM pairs) WHERE rn <= {k})"""


def _walk(k: int, turn: bool = False) -> str:
    """The shortest walks between nations; none is longer than there are nations."""
    a, b = ("dst", "src") if turn else ("src", "dst")
    return f"""WITH RECURSIVE {_edges(k)}, e AS (SELECT {a} AS src, {b} AS dst FROM edges),
walk AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN e ON w.dst = e.src WHERE w.depth < (SELECT count(*) FROM nation)),
reach AS (SELECT src, dst, min(depth) AS depth FROM walk GROUP BY ALL) """


@query(f"WITH {_edges(1)} SELECT src, dst, n FROM edges")
def edges_topk(spark, d):
    return trade(spark, d, 1)


@query(_walk(1) + "SELECT src, dst, depth FROM reach")
def closure_min_depth(spark, d):
    return graph.closure(trade(spark, d, 1))


@query(_walk(2) + "SELECT src AS node, depth AS length FROM reach WHERE src = dst")
def cycle_members(spark, d):
    return graph.cycle_members(trade(spark, d, 2))


@query(f"""WITH RECURSIVE {_edges(2)}, paths AS (SELECT src AS head, [src] AS path, src AS last FROM edges
  UNION SELECT head, list_append(path, dst), dst FROM paths JOIN edges ON last = src WHERE dst > head AND NOT list_contains(path, dst))
SELECT DISTINCT array_to_string(path, '>') AS cycle FROM paths JOIN edges ON last = src AND dst = head""")
def canonical_cycles(spark, d):
    return graph.simple_cycles(trade(spark, d, 2)).select(F.array_join("cycle", ">").alias("cycle"))


@query("""SELECT page_id, i - 1 AS ord, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(generate_series(1, len(hrefs))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages))""")
def link_extract(spark, d):
    return links_of(table(spark, d, "pages"), "page_id", "html", 'href="([^"]*)"').select("page_id", F.col("ord").cast("long").alias("ord"), "href")


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))


_BANDS = "SELECT o_orderpriority AS p, min(o_totalprice) / 1000 AS lo, avg(o_totalprice) / 1000 AS hi FROM orders GROUP BY ALL"


def _bands(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg((F.min("o_totalprice") / 1000).alias("lo"), (F.avg("o_totalprice") / 1000).alias("hi"))


@query(f"SELECT p, event_type, count(*) AS n FROM events JOIN ({_BANDS}) ON value BETWEEN lo AND hi GROUP BY ALL")
def interval_lookup(spark, d):
    return rel.interval_lookup(table(spark, d, "events"), _bands(spark, d), [], "value", "lo", "hi", width=10.0).groupBy("p", "event_type").agg(F.count("*").alias("n"))


@query(f"SELECT p, event_type, count(*) AS n FROM (SELECT event_id, event_type, p, row_number() OVER (PARTITION BY event_id ORDER BY p) AS rn FROM events JOIN ({_BANDS}) ON value BETWEEN lo AND hi) WHERE rn = 1 GROUP BY ALL")
def first_in_interval(spark, d):
    return rel.interval_lookup(table(spark, d, "events"), _bands(spark, d), [], "value", "lo", "hi", ["p"], ["event_id"], width=10.0).groupBy("p", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders SEMI JOIN (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION
  SELECT l_orderkey FROM lineitem WHERE l_quantity > 48 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey FROM orders WHERE o_totalprice < 1000) ON o_orderkey = k""")
def changed_files(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    ids = rel.changed_set(li.where("l_returnflag = 'R'").select("l_orderkey"), li.where("l_quantity > 48").select("l_orderkey"), o.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), o.where("o_totalprice < 1000").select("o_orderkey"))
    return o.join(ids.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query(_walk(2, True) + "SELECT src AS node, dst AS dependent, depth FROM reach")
def dependents_closure(spark, d):
    return graph.dependents(trade(spark, d, 2))


@query(f"WITH {_edges(2)} SELECT x.src AS a, x.dst AS b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def mutual_edges(spark, d):
    return graph.mutual_edges(trade(spark, d, 2))


@query("""SELECT c_custkey, arg_min(n_name, prio) AS resolved FROM (SELECT c_custkey, unnest(['Segment ' || c_mktsegment, c.n_name, 'NATION_' || c_nationkey]) AS n_name, unnest([0, 1, 2]) AS prio
  FROM customer JOIN nation c ON c_nationkey = n_nationkey) t WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY ALL
UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_nationkey % 2 = 1""")
def resolve_first(spark, d):
    n = table(spark, d, "nation")
    wanted = table(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey)
    tries = F.array(F.concat(F.lit("Segment "), "c_mktsegment"), "n_name", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return rel.resolve_first(wanted, "c_custkey", tries, n.where("n_nationkey % 2 = 0").select("n_name"), "n_name")


@query("""SELECT l_orderkey, l_linenumber, step, action FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, step) AS rn FROM (
  SELECT l_orderkey, l_linenumber, 1 AS step, 'safe' AS action FROM lineitem WHERE l_discount < 0.02 UNION ALL
  SELECT l_orderkey, l_linenumber, 2, 'stop' FROM lineitem WHERE l_returnflag = 'A' UNION ALL
  SELECT l_orderkey, l_linenumber, 3, 'confirmed' FROM lineitem WHERE l_quantity > 30)) WHERE rn = 1 AND action <> 'stop'""")
def rule_ladder(spark, d):
    steps = [("l_discount < 0.02", "safe"), ("l_returnflag = 'A'", "stop"), ("l_quantity > 30", "confirmed")]
    return rel.ladder(table(spark, d, "lineitem"), steps, ["l_orderkey"], ["l_linenumber"], ["l_linenumber"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '2-HIGH', '1-URGENT')")
def min_level_filter(spark, d):
    return rel.at_least(table(spark, d, "orders"), "o_orderpriority", PRIORITIES, "3-MEDIUM").select("o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT p_brand AS name FROM part WHERE regexp_matches(p_brand, '^Brand#[1-4]') OR p_brand = 'Brand#55' EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size = 1 AND p_type LIKE '%A%'")
def preset_merge(spark, d):
    part = table(spark, d, "part")
    return rel.merge_preset(stable_names(part.select(F.col("p_brand").alias("name")), "name", ["Brand#55"], ["^Brand#[1-4]"]), part.where("p_size = 1 and p_type like '%A%'").select("p_brand"))


@query("""SELECT doc_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))
WHERE trim(line) <> '' AND NOT regexp_matches(line, '!!') AND NOT coalesce(regexp_matches(prev, 'license|\\|'), false)""")
def ignore_lines(spark, d):
    return rel.unignored_lines(table(spark, d, "documents"), "doc_id", "text", "!!", r"license|\|").withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_write_wins(spark, d):
    return rel.last_write(table(spark, d, "events"), ["user_id"], "event_id", "event_type", "value")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n, min(l_partkey) AS first FROM lineitem GROUP BY ALL")
def reverse_index(spark, d):
    return rel.reverse_index(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT count(*) AS files, count_if(l_returnflag = 'R') AS confirmed, count_if(l_returnflag = 'A') AS warnings, count(*) - count_if(l_quantity > 10) AS filtered,
  CASE WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS exit_code FROM lineitem""")
def summary_rollup(spark, d):
    return sinks.summary(table(spark, d, "lineitem"), {"confirmed": "l_returnflag = 'R'", "warnings": "l_returnflag = 'A'"}, "l_quantity > 10", "l_returnflag = 'R'")


@query("SELECT event_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS seen FROM events")
def running_set_size(spark, d):
    return rel.running_set(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select("event_id", "seen")


@query(f"""WITH RECURSIVE {_edges(2)}, reach0 AS (SELECT dst FROM edges WHERE src = 0 UNION SELECT e.dst FROM reach0 r JOIN edges e ON r.dst = e.src),
nodes AS (SELECT dst AS node FROM reach0 UNION SELECT 0),
cut AS (SELECT node AS out, 0 AS node FROM nodes WHERE node <> 0 UNION SELECT c.out, e.dst FROM cut c JOIN edges e ON c.node = e.src AND e.dst <> c.out)
SELECT n.node, o.node AS dominator FROM nodes n CROSS JOIN nodes o ANTI JOIN cut c ON c.out = o.node AND c.node = n.node""")
def dominators_small(spark, d):
    return graph.dominators(trade(spark, d, 2), 0)


@query(f"""WITH RECURSIVE {_edges(2)}, paths AS (SELECT [src, dst] AS path, dst AS last FROM edges WHERE src < 3 AND src <> dst
  UNION SELECT list_append(path, dst), dst FROM paths JOIN edges ON last = src WHERE len(path) < 4 AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path FROM paths""")
def bounded_paths(spark, d):
    start = spark.range(3).select(F.col("id").cast("int").alias("src"))
    return graph.simple_paths(trade(spark, d, 2), start, 4).select(F.array_join("path", ">").alias("path"))


@query("SELECT user_id, a, b, count(*) AS n FROM (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY ALL")
def path_conditions(spark, d):
    return rel.consecutive(table(spark, d, "events"), "user_id", ["event_id"], "event_type")


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
  SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL""")
def sessions(spark, d):
    return rel.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours", ["ts", "event_id"])


@query("""SELECT DISTINCT s_suppkey AS k, s_name AS name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity = 50 UNION SELECT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'
UNION SELECT p_partkey, p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_tax = 0.08 AND l_quantity < 5""")
def memo_lookup(spark, d):
    li, s, c, o, p = (table(spark, d, t) for t in ("lineitem", "supplier", "customer", "orders", "part"))
    one = s.join(li.where("l_quantity = 50"), s.s_suppkey == li.l_suppkey, "left_semi").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    two = c.join(o.where("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")
    return rel.changed_set(one, two, p.join(li.where("l_tax = 0.08 and l_quantity < 5"), p.p_partkey == li.l_partkey, "left_semi").select("p_partkey", "p_name"))


_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'warning' ELSE 'note' END"


@query(f"SELECT o_orderkey, {_LEVEL} AS level, o_orderstatus AS rule, o_orderpriority || ': ' || o_orderstatus AS message FROM orders")
def sarif_rows(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", sinks.sarif_level(F.col("o_orderpriority"), "1-URGENT", "2-HIGH").alias("level"), F.col("o_orderstatus").alias("rule"), F.concat_ws(": ", "o_orderpriority", "o_orderstatus").alias("message"))


@query(f"SELECT o_orderkey, printf('%d:%d - %s %s: %s', o_orderkey, o_custkey, {_LEVEL}, o_orderstatus, string_split(o_orderpriority, '-')[1]) AS line FROM orders")
def compact_lines(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.format_string("%d:%d - %s %s: %s", "o_orderkey", "o_custkey", sinks.sarif_level(F.col("o_orderpriority"), "1-URGENT", "2-HIGH"), "o_orderstatus", F.substring_index("o_orderpriority", "-", 1)).alias("line"))


@query("SELECT page_id, regexp_matches(html, '<script[^>]*>') AS scripts, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages")
def html_scan(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").rlike("<script[^>]*>").alias("scripts"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


QUERIES = dict(_QUERIES)
SQL = dict(_SQL)
