"""Name lookups by list or pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_matches(name: Column, names: list[str], patterns: list[str]) -> Column:
    """Whether a name stands in the list or a pattern finds something in it; no list and no pattern match nothing."""
    test = F.lit(False)
    if names:
        test = test | name.isin(names)
    for p in patterns:
        test = test | name.rlike(p)
    return test


def stable_names(df: DataFrame, column: str, names: list[str], patterns: list[str]) -> DataFrame:
    """Distinct names that the list or a pattern declares stable."""
    return df.select(column).distinct().where(name_matches(F.col(column), names, patterns))


def plain_name(name: Column) -> Column:
    """Whether a name can't change between renders: a constant in capitals, a number, a quoted text, a keyword or a member."""
    return name.rlike(r"^[A-Z][A-Z0-9_]*$") | name.rlike(r"^-?[0-9.]+$") | name.rlike(r"""^['"`]""") | name.isin("true", "false", "null", "undefined") | name.contains(".")


def component_name(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def setter_name(name: Column) -> Column:
    return name.rlike("^set[A-Z]")
