"""Names, paths and settings resolved against tables: nearest ancestors, aliases, layers of settings, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.relational import first_of


def ancestors(path: Column) -> Column:
    """The folders above a slash-separated path, the nearest first; none above a path without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def nearest_ancestor(paths: DataFrame, key: str, path: str, known: DataFrame, name: str) -> DataFrame:
    """(key, nearest): the longest folder above each path that stands in ``known(name)``, null if none does, as a file's
    governing configuration. Folders meet by equality, so that files are not compared with all folders."""
    above = paths.select(key, F.posexplode(ancestors(F.col(path))).alias("_far", name))
    found = above.join(known.select(name).distinct(), name).groupBy(key).agg(F.min_by(name, "_far").alias("nearest"))
    return paths.select(key).distinct().join(found, key, "left")


def expand_aliases(wanted: DataFrame, source: str, aliases: DataFrame) -> DataFrame:
    """``wanted`` with (prio, candidate): the targets of the longest alias that is ``source`` or a folder above it, in order.

    ``aliases`` are (alias, target, ord). The rest of the source follows the target. Sources without an alias are left out.
    """
    tries = wanted.withColumn("_try", F.explode(F.array_prepend(ancestors(F.col(source)), F.col(source))))
    listed = aliases.groupBy(F.col("alias").alias("_try")).agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("_targets"))  # a setting's few targets
    hit = first_of(tries.join(listed, "_try").withColumn("_short", -F.length("_try")), wanted.columns, ["_short"])
    rest = F.substring(F.col(source), F.length("_try") + 1, F.length(source))
    return hit.select(*wanted.columns, F.posexplode("_targets").alias("prio", "_target"), rest.alias("_rest")).select(*wanted.columns, "prio", F.concat("_target.target", "_rest").alias("candidate"))


def original_names(used: DataFrame, local: str, renames: DataFrame) -> DataFrame:
    """``used`` with ``original``: the name that ``renames(local, imported)`` gives to a local one, itself without one."""
    joined = used.join(renames.select(*[c for c in renames.columns if c != "imported"], "imported"), [c for c in renames.columns if c != "imported"], "left")
    return joined.select(*used.columns, F.coalesce("imported", local).alias("original"))


def manifest_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) of the rows that differ between two manifests: added, removed or changed."""
    both = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was")).join(new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is")), key, "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def merged_scalars(settings: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """(name, value): of each setting the value of the last layer."""
    return settings.groupBy(name).agg(F.max_by(value, F.struct(*order)).alias(value))


def merged_lists(settings: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """(name, values): the distinct values of all layers of each setting, by where they stand first."""
    first = settings.groupBy(name, value).agg(F.min(F.struct(*order)).alias("_first"))
    return first.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))


def minus(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key stands in none of the others."""
    return reduce(lambda left, right: left.join(right.select(key), key, "left_anti"), others, df)


def since_reset(df: DataFrame, key: str, order: str, reset: str) -> DataFrame:
    """Rows after the last one of their key for which ``reset`` holds; keys without one keep all rows."""
    last = df.where(F.expr(reset)).groupBy(key).agg(F.max(order).alias("_last"))
    return df.join(last, key, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")
