"""Rollups and report rows that sinks write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, counts: dict[str, str], kept: str, fails: str) -> DataFrame:
    """One row: all rows, a count for each condition, rows that the result filter drops, and the exit code."""
    return df.agg(
        F.count("*").alias("files"),
        *(F.count_if(F.expr(test)).alias(name) for name, test in counts.items()),
        (F.count("*") - F.count_if(F.expr(kept))).alias("filtered"),
        F.when(F.bool_or(F.expr(fails)), 1).otherwise(0).alias("exit_code"),
    )


def sarif_level(category: Column, error: str, warning: str) -> Column:
    return F.when(category == error, "error").when(category == warning, "warning").otherwise("note")


def json_rows(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``json``: each row as one JSON object, for ``write.text``."""
    return df.select(*keep, F.to_json(F.struct(*df.columns)).alias("json"))


def sarif_result(rule: Column, level: Column, message: Column, uri: Column, line: Column) -> Column:
    """A SARIF result object as JSON text: one row each, so that no report is gathered in one task."""
    place = F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region"))
    return F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations")))


def sarif_head(rules: DataFrame, rule: str, text: str) -> DataFrame:
    """(json): the tool object of a SARIF run with the catalogue of rules, which is small."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rule).alias("id"), F.struct(F.col(text).alias("text")).alias("shortDescription"))))
    return rules.agg(F.to_json(F.struct(F.struct(F.lit("quillmesh").alias("name"), listed.alias("rules")).alias("driver"))).alias("json"))


def code_frames(df: DataFrame, key: str, text: str, hit: str, around: int = 2) -> DataFrame:
    """(key, hit_line, line_no, line): the lines around each line that matches ``hit``, cut from the row's own text."""
    cut = df.select(key, F.split(F.col(text), "\n").alias("_lines"))
    hits = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(hit), i)), lambda i: i.isNotNull())
    rows = cut.select(key, "_lines", F.explode(hits).alias("hit_line"))
    first = F.greatest(F.col("hit_line") - around, F.lit(0))
    frame = F.slice("_lines", first + 1, F.least(F.col("hit_line") + around, F.size("_lines") - 1) - first + 1)
    return rows.select(key, "hit_line", first.alias("_first"), F.posexplode(frame).alias("_k", "line")).select(key, "hit_line", (F.col("_first") + F.col("_k")).alias("line_no"), "line")


def dot_lines(edges: DataFrame, src: str, dst: str, label: str | None = None) -> DataFrame:
    """(line): a DOT statement for each edge; header and closing brace are the writer's."""
    text = F.concat(F.lit('  "'), F.col(src).cast("string"), F.lit('" -> "'), F.col(dst).cast("string"), F.lit('"'))
    return edges.select(F.concat(text, F.concat(F.lit(' [label="'), F.col(label).cast("string"), F.lit('"]')) if label else F.lit(""), F.lit(";")).alias("line"))
