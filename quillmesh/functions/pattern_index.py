"""Many patterns against many names: a literal piece of each pattern is looked up before the pattern is tried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.shared import written

#: Pieces have at most so many characters.
PIECE = 8
#: Names whose pieces are listed by one task, roughly, and patterns that are broadcast, at most.
TOGETHER, FEW = 50_000, 100_000
#: More patterns than ``FEW`` are shuffled; then the names of a piece are dealt to so many parts.
PARTS = 32
_STARTS = "([{"


def literals(pattern: str) -> list[str]:
    """Texts that stand in whatever the pattern finds; none where that can't be told.

    Only what every match must hold counts: alternatives at the top, and whatever stands in groups, classes or braces or may be
    left out, give nothing.
    """
    runs, run, k, depth = [], "", 0, 0
    if pattern.startswith("(?"):  # flags or a lookaround in front may change what letters mean
        return []
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            following = pattern[k + 1 : k + 2]
            k += 2
            if depth == 0 and following and not following.isalnum():
                run += following
                continue
            if following == "Q" or following.isdigit() or following in "xucpPkN":  # quoting and escapes with an argument
                return []
        elif c == "[":
            end = k + 1
            nested = 1
            while end < len(pattern) and nested:
                if pattern[end] == "\\":
                    end += 1
                elif pattern[end] == "[":
                    nested += 1
                elif pattern[end] == "]" and not (end == k + 1 or pattern[k + 1 : end] == "^"):
                    nested -= 1
                end += 1
            k = end
        elif c in "()":
            depth += 1 if c == "(" else -1
            k += 1
        elif c == "|":
            if depth == 0:
                return []
            k += 1
        elif c in "*?{":
            if depth == 0:
                run = run[:-1]
            if c == "{":
                k = pattern.find("}", k)
                if k < 0:
                    return []
            k += 1
        elif c in ".^$+":
            k += 1
        else:
            if depth == 0:
                run += c
                k += 1
                continue
            k += 1
        runs.append(run)
        run = ""
    # a quantifier behind a group makes the group optional, which gave nothing anyway
    return [r for r in [*runs, run] if r]


def _pieces(run: str) -> list[str]:
    """The run, or windows of ``PIECE`` characters that cover it."""
    return [run] if len(run) <= PIECE else [*(run[i : i + PIECE] for i in range(0, len(run) - PIECE, PIECE)), run[-PIECE:]]


def _parts(name: str) -> set[str]:
    """All texts of up to ``PIECE`` characters inside a name, the empty one too."""
    return {name[i : i + q] for q in range(1, PIECE + 1) for i in range(len(name) - q + 1)} | {""}


def pattern_hits(names: DataFrame, name: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Distinct (name, pattern) where the pattern finds something in the name.

    Each pattern is listed under the rarest of its pieces among the names, and met by the names that have the piece; only
    then it is tried. Patterns without a piece meet all names, by equality on an empty piece. A pattern that a name's pieces
    lack is never tried. Null names and patterns match nothing. Names are never broadcast, whatever Spark takes their
    size for; patterns are if they are few, otherwise both sides are shuffled by piece and a part of the names.
    """

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = [sorted({x for run in literals(p) for x in _pieces(run)}) or [""] for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(listed, pa.list_(pa.string()))], names=["_pattern", "pieces"])

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                texts = whole.column(0).slice(at, 500)
                parts = [_parts(t) for t in texts.to_pylist()]
                flat = pa.array([x for p in parts for x in p], pa.string())
                yield pa.RecordBatch.from_arrays([texts.take(pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))), flat], names=["_name", "piece"])

    rows = names.select(F.col(name).cast("string").alias("_name")).where("_name is not null")
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TOGETHER))
    held = rows.repartition(tasks, "_name").distinct().mapInArrow(parts_of, "_name string, piece string")
    listed = patterns.select(F.col(pattern).cast("string").alias("_pattern")).where("_pattern is not null").distinct().mapInArrow(pieces_of, "_pattern string, pieces array<string>").select("_pattern", F.explode("pieces").alias("piece"))
    often = held.join(listed.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    # every piece of a pattern must be there: the pattern waits under the rarest, and is dropped if one is missing
    rarest = listed.join(often, "piece", "left").groupBy("_pattern").agg(F.bool_or(F.col("n").isNull()).alias("missing"), F.min(F.struct("n", "piece")).alias("least")).where("not missing").select("_pattern", F.col("least.piece").alias("piece"))
    rarest = written(rarest)
    if rarest.limit(FEW + 1).count() <= FEW:
        met = held.join(F.broadcast(rarest), "piece")
    else:
        part = F.pmod(F.xxhash64("_name"), F.lit(PARTS)).alias("part")
        met = held.select("_name", "piece", part).hint("merge").join(rarest.withColumn("part", F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)"))), ["piece", "part"])
    return met.where(F.regexp_like(F.col("_name"), F.col("_pattern"))).select(F.col("_name").alias(name), F.col("_pattern").alias(pattern))


def judged_names(names: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """(name, stable, unstable): whether ``rules(kind, value, is_pattern)`` of a kind hold the name, as a text or a pattern.

    Whatever is joined is grouped before, so that Spark sees its size and broadcasts nothing large.
    """
    known = names.select(F.col(name).alias("_n")).where("_n is not null").distinct()
    of = lambda rows, key: rows.groupBy(key).agg(F.bool_or(F.col("kind") == "stable").alias("s"), F.bool_or(F.col("kind") == "unstable").alias("u"))
    patterns = of(rules.where("is_pattern and value is not null"), "value")
    found = pattern_hits(known, "_n", patterns, "value").join(patterns, "value").select("_n", "s", "u")
    texts = of(rules.where("not is_pattern").withColumnRenamed("value", "_n"), "_n")
    flags = texts.unionByName(found).groupBy("_n").agg(F.bool_or("s").alias("s"), F.bool_or("u").alias("u"))
    return known.join(flags, "_n", "left").select(F.col("_n").alias(name), F.coalesce("s", F.lit(False)).alias("stable"), F.coalesce("u", F.lit(False)).alias("unstable"))


def preset_rules(dependencies: DataFrame, presets: DataFrame) -> DataFrame:
    """(project, kind, value): what the presets of a project's dependencies declare, each once.

    ``dependencies(project, package)``; ``presets(package, kind, value)`` where a preset has a row for each package that
    brings it in and each name it declares.
    """
    return dependencies.join(presets, "package").select("project", "kind", "value").distinct()


def custom_functions(used: DataFrame, name: str, declared: DataFrame) -> DataFrame:
    """``used`` with what ``declared(name, stable, deferred)`` says of the name; null where it says nothing."""
    return used.join(declared.select(F.col("name").alias(name), "stable", "deferred"), name, "left")
