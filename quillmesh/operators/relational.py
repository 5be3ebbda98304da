"""First-match, interval, last-write and set operators over any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.shared import written

#: How severities and confidences compare.
LEVELS = {"low": 1, "medium": 2, "high": 3}


def ordinal(column: Column, order: list[str]) -> Column:
    """Position of a value in ``order``, from 1; null for others. Levels never compare as strings."""
    return F.coalesce(*(F.when(column == v, F.lit(k)) for k, v in enumerate(order, 1)))


def at_least(df: DataFrame, column: str, order: list[str], least: str, null_passes: bool = False) -> DataFrame:
    """Rows whose level is ``least`` or above."""
    level = ordinal(F.col(column), order)
    keep = level >= order.index(least) + 1
    return df.where(keep | level.isNull() if null_passes else keep)


def first_match(candidates: list[DataFrame], group: list[str], order: list[str], action: str = "action", stop: str = "stop") -> DataFrame:
    """The first candidate row of each group by ``order``; groups whose first is a stop row vanish. For candidates of unlike
    sources; steps over one table are a ``ladder``."""
    rows = reduce(DataFrame.unionByName, candidates)
    return first_of(rows, group, order).where(F.col(action) != stop)


def first_of(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by a grouped minimum, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in group]
    first = rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*group, *(F.col(f"_first.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def ladder(rows: DataFrame, steps: list[tuple[str, str]], group: list[str], order: list[str], keep: list[str], stop: str = "stop") -> DataFrame:
    """``group``, ``keep``, step and action of the first row of each group, by ``order`` and then step, that a step's condition
    admits. ``steps`` are (condition, action), numbered from 1; groups whose first action is ``stop`` vanish. One scan."""
    step = F.coalesce(*(F.when(F.expr(test), F.lit(k)) for k, (test, _) in enumerate(steps, 1)))
    admitted = rows.select(*group, *dict.fromkeys([*order, *keep]), step.alias("step")).where("step is not null")
    action = F.element_at(F.array(*(F.lit(a) for _, a in steps)), F.col("step"))
    first = first_of(admitted, group, [*order, "step"]).withColumn("action", action).where(F.col("action") != stop)
    return first.select(*group, *keep, "step", "action")


def interval_lookup(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str, first_by: list[str] | None = None, point_key: list[str] | None = None, width: float = 1.0) -> DataFrame:
    """Points joined to the ranges, of equal ``keys`` if any, that hold them; with ``first_by`` the first range of each point only.

    Points and ranges meet by bins of ``width``: a range is listed in each bin it touches, a point in its own. Choose
    ``width`` near the usual range, so that ranges touch few bins and bins hold few points. Null ends hold nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    listed = ranges.where(f"`{low}` <= `{high}`").withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    hit = points.withColumn("_bin", bin_of(point)).join(listed, [*keys, "_bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_bin")
    return hit if first_by is None else first_of(hit, point_key, first_by)


def resolve_first(wanted: DataFrame, key: str, candidates: Column, known: DataFrame, name: str) -> DataFrame:
    """Each key's first candidate name that is known, null if none: candidates are tried in array order."""
    tried = wanted.select(key, F.posexplode(candidates).alias("prio", name))
    found = tried.join(known.select(name).distinct(), name).groupBy(key).agg(F.min_by(name, "prio").alias("resolved"))
    return wanted.select(key).distinct().join(found, key, "left")


def last_write(df: DataFrame, key: list[str], order: str, *values: str) -> DataFrame:
    """The values of the row with the largest ``order`` of each key, all from one row where several share it."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.select(*key, *(F.col(f"_last.`{v}`").alias(v) for v in values))


def changed_set(*lists: DataFrame) -> DataFrame:
    """Distinct union of id lists."""
    return reduce(DataFrame.union, lists).distinct()


def merge_preset(stable: DataFrame, unstable: DataFrame) -> DataFrame:
    """Distinct stable names that are not unstable."""
    return stable.distinct().subtract(unstable)


def reverse_index(edges: DataFrame, dst: str, src: str) -> DataFrame:
    """Per target: how many distinct sources, and the smallest."""
    return edges.groupBy(dst).agg(F.countDistinct(src).alias("n"), F.min(src).alias("first"))


def _largest(df: DataFrame, key: str) -> int:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def blocked(df: DataFrame, key: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``_block``: ranges of rows by key and order, of about equal size, numbered in that order and written, so that
    they stay as they are. Rows equal in key and order share a block; a key with most rows is spread over most blocks."""
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(blocks, key, *order).withColumn("_block", F.spark_partition_id()))


def _carried(rows: DataFrame, key: str, total: Column, carry, name: str) -> DataFrame:
    """``rows`` with what earlier blocks of the key hand on: ``carry`` of their totals over a window by block.

    Only keys in more than one block matter. Two neighbouring blocks share one key at most, so there are no more than two such
    rows for each block: they are broadcast."""
    totals = rows.groupBy(key, "_block").agg(total.alias("_total"))
    over = Window.partitionBy(key)
    many = totals.withColumn("_n", F.count("*").over(over)).where("_n > 1").select(key, "_block", carry(Window.partitionBy(key).orderBy("_block")).alias(name))
    return rows.join(F.broadcast(many.withColumnRenamed(key, "_key")), F.col(key).eqNullSafe(F.col("_key")) & (rows["_block"] == many["_block"]), "left").drop(many["_block"]).drop("_key")


def prefix_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` of ``blocked`` with the sum of ``value`` over the key's rows up to each: sums inside blocks, and of whole blocks
    before. No task has more than a block."""
    before = lambda w: F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = _carried(rows, key, F.sum(value), before, "_before")
    inside = F.sum(value).over(Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return carried.withColumn(name, inside + F.coalesce("_before", F.lit(0))).drop("_before")


#: Keys with more rows are cut into blocks; up to so many rows of a key are one task's work.
MOST = 1_000_000


def running_set(df: DataFrame, key: str, order: list[str], value: str, most: int = MOST) -> DataFrame:
    """With ``seen``: how many distinct values of the key up to this row. Null values count as one value.

    If a key has more than ``most`` rows, rows are cut into blocks by key and order: the first row of each value comes from a
    grouped minimum, and its running count from block sums.
    """
    if _largest(df, key) <= most:
        first = F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) == 1
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_first", first.cast("long")).withColumn("seen", F.sum("_first").over(w)).drop("_first")
    rows = blocked(df, key, order)
    at = F.struct(*order)
    firsts = rows.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.min(at).alias("_at"))
    same = rows[key].eqNullSafe(F.col("_k")) & rows[value].eqNullSafe(F.col("_v")) & (at == F.col("_at"))
    rows = rows.join(firsts, same, "left").withColumn("_first", F.col("_at").isNotNull()).drop("_k", "_v", "_at")
    beside = Window.partitionBy(key, "_block").orderBy(*order, value)  # of rows alike in key, order and value one counts
    again = F.coalesce(F.lag("_first").over(beside) & F.lag(at).over(beside).eqNullSafe(at) & F.lag(value).over(beside).eqNullSafe(F.col(value)), F.lit(False))
    rows = rows.withColumn("_first", (F.col("_first") & ~again).cast("long"))
    return prefix_sum(rows, key, [*order, value], "_first", "seen").drop("_first", "_block")


def _sessions(df: DataFrame, key: str, ts: str, gap: str, order: list[str], most: int) -> DataFrame:
    """``df`` with ``session``: a number that rises with each row more than ``gap`` after the one before it."""
    later = lambda before: F.coalesce(F.col(ts) > before + F.expr(f"interval {gap}"), F.lit(True)).cast("long")
    if _largest(df, key) <= most:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumn("_new", later(F.lag(ts).over(w))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rows = blocked(df, key, order)
    last = F.max_by(F.struct(F.col(ts).alias("ts")), F.struct(*order))
    carried = _carried(rows, key, last, lambda w: F.lag("_total").over(w), "_earlier")
    before = F.coalesce(F.lag(F.struct(F.col(ts).alias("ts"))).over(Window.partitionBy(key, "_block").orderBy(*order)), F.col("_earlier"))["ts"]
    return prefix_sum(carried.withColumn("_new", later(before)).drop("_earlier"), key, order, "_new", "session").drop("_new", "_block")


def two_tier(df: DataFrame, file: str, project: str, ts: str, fast: str, slow: str, most: int = MOST) -> DataFrame:
    """(tier, key, start, n): bursts of events of each file by the gap ``fast``, and of each project by ``slow``, as quick
    checks of one file and full runs are put off; an event at a gap's very end still belongs. Events without time are left out."""

    def tier(k: int, key: str, gap: str) -> DataFrame:
        rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).where("ts is not null")
        return _sessions(rows, "key", "ts", gap, ["ts"], most).groupBy("key", "session").agg(F.min("ts").alias("start"), F.count("*").alias("n")).select(F.lit(k).alias("tier"), "key", "start", "n")

    return tier(1, file, fast).unionByName(tier(2, project, slow))


def sessions(df: DataFrame, key: str, ts: str, gap: str, order: list[str], most: int = MOST) -> DataFrame:
    """(key, session, n): a row more than ``gap`` after the one before it starts a session; the batch form of a debounce.

    If a key has more than ``most`` rows, rows are cut into blocks by key and order, so that no task has more than a block.
    """
    return _sessions(df, key, ts, gap, order, most).groupBy(key, "session").agg(F.count("*").alias("n"))


def consecutive(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, a, b, n): how often value b follows value a directly."""
    nxt = F.lead(value).over(Window.partitionBy(key).orderBy(*order))
    pairs = df.select(key, F.col(value).alias("a"), nxt.alias("b")).where("b is not null")
    return pairs.groupBy(key, "a", "b").agg(F.count("*").alias("n"))


def unignored_lines(df: DataFrame, key: str, text: str, same: str, before: str) -> DataFrame:
    """(key, line_no, line): non-blank lines that neither match ``same`` nor follow a line that matches ``before``."""
    # each line beside the one before it, inside the row's array: nothing is shuffled
    cut = df.select(key, F.split(F.col(text), "\n").alias("line"))
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("line", 1, F.size("line") - 1)).alias("prev")
    rows = cut.select(key, "line", prev).select(key, F.posexplode(F.arrays_zip("line", "prev")).alias("line_no", "x")).select(key, "line_no", "x.line", "x.prev")
    return rows.where((F.trim("line") != "") & ~F.col("line").rlike(same) & ~F.coalesce(F.col("prev").rlike(before), F.lit(False))).select(key, "line_no", "line")
