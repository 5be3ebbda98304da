"""Lightweight import and link scans by regular expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links_of(df: DataFrame, key: str, text: str, pattern: str, name: str = "href") -> DataFrame:
    """(key, ord, name): the first group of each match of ``pattern``, numbered from 0 in text order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("ord", name))
