"""Effects that calls have through the functions they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import first_derivations
from quillmesh.operators.relational import first_of
from quillmesh.operators.shared import written


def named_functions(functions: DataFrame) -> DataFrame:
    """(name, file): what a call by name means: the last exported function of that name, else the first one, by ``ord``."""
    rank = F.when(F.col("exported"), -F.col("ord")).otherwise(F.col("ord"))
    rows = functions.select("name", "file", (~F.col("exported")).alias("_own"), rank.alias("_rank"))
    return first_of(rows, ["name"], ["_own", "_rank"]).select("name", "file")


def setter_flows(calls: DataFrame, functions: DataFrame, inner: DataFrame) -> DataFrame:
    """(hook, call, setters): of each hook the setters that its last effective call leads to, in the order of derivation.

    ``calls(hook, ord, name, passes)`` are calls in hooks with the number of setters they pass; a call counts if it passes one
    and leads to a setter. ``functions(name, file, exported, ord, setters)`` hold the setters that each calls itself, in order,
    ``inner(name, file, ord, callee)`` the functions it calls. A function's own setters come before those of its calls, these
    in the order of the calls; each setter counts where it is found first, and a function does not call itself again.
    """
    known = written(named_functions(functions))
    own = functions.join(known, ["name", "file"], "left_semi").select("name", F.posexplode("setters").alias("pos", "setter"))
    steps = inner.join(known, ["name", "file"], "left_semi").join(known.select(F.col("name").alias("callee")), "callee", "left_semi")
    steps = steps.select(F.col("name").alias("src"), F.col("callee").alias("dst"), (F.col("ord") + 1).alias("ord"))  # 0 is a function's own part
    effective = calls.where("passes > 0").select("hook", F.col("ord").alias("call"), "name")
    ways = first_derivations(steps, effective.join(known, "name", "left_semi").select(F.col("name").alias("src")))
    found = ways.join(own.withColumnRenamed("name", "dst"), "dst").select("src", "setter", F.concat("path", F.array(F.lit(0), F.col("pos"))).alias("at"))
    found = found.groupBy("src", "setter").agg(F.min("at").alias("at")).groupBy(F.col("src").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "setter"))), lambda x: x["setter"]).alias("setters"))
    last = effective.join(found, "name").groupBy("hook").agg(F.max_by(F.struct("call", "setters"), "call").alias("last"))
    return last.select("hook", "last.call", "last.setters")
