"""Incremental analysis of document events (ts, path, op, content) with Structured Streaming.

Each micro-batch keeps the latest event of each path, drops those whose content hash is the known one, writes the rest as the
batch's delta, and hands the changed paths and their dependents to a sink. The state is the last compacted table with the
deltas since. Micro-batches run one at a time, so changes that arrive meanwhile are coalesced into the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators import graph
from quillmesh.operators.relational import last_write

STATE = "path string, md5 string, ts timestamp, content string"
DELTA = f"{STATE}, op string"
#: After so many batches the state is written whole; older deltas and states may then go.
COMPACT = 20


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path: of equal times the larger operation name, then content, so that replays agree."""
    order = F.struct("ts", "op", F.coalesce("content", F.lit("")))
    return last_write(events.withColumn("_o", order), ["path"], "_o", "ts", "op", "content").withColumn("md5", F.md5(F.coalesce("content", F.lit("")).cast("binary")))


def changes(events: DataFrame, state: DataFrame) -> DataFrame:
    """Latest events that differ from the state: new or other content, or an unlink of a known path. A change back passes."""
    now = latest(events)
    known = state.select("path", F.col("md5").alias("_old"))
    both = now.join(known, "path", "left")
    return both.where(F.when(F.col("op") == "unlink", F.col("_old").isNotNull()).otherwise(F.col("_old").isNull() | (F.col("_old") != F.col("md5")))).drop("_old")


def merged(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The state after the changes; unlinked paths are gone."""
    kept = state.join(changed.select("path"), "path", "left_anti").select("path", "md5", "ts", "content")
    return kept.unionByName(changed.where("op != 'unlink'").select("path", "md5", "ts", "content"))


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): changed paths and all that depend on them over ``edges(src, dst)``, src importing dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    after = graph.closure(back, start=changed.select(F.col("path").alias("src"))).select(F.col("dst").alias("path"))
    return changed.select("path").union(after).distinct()


def _paths(spark: SparkSession, folder: str, kind: str, numbers: Iterable[int]) -> list[str]:
    """Folders of that kind and these numbers that were written whole."""
    at = [f"{folder}/{kind}-{k}" for k in numbers]
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    return [p for p in at if (mark := hadoop.Path(f"{p}/_SUCCESS")).getFileSystem(conf).exists(mark)]


def state_before(spark: SparkSession, folder: str, number: int, compact: int = COMPACT) -> DataFrame:
    """The files as they were before batch ``number``."""
    base, first = spark.createDataFrame([], STATE), 0
    for k in range((number // compact) * compact - 1, -1, -compact):
        if found := _paths(spark, folder, "state", [k]):
            base, first = spark.read.schema(STATE).parquet(*found), k + 1
            break
    deltas = _paths(spark, folder, "delta", range(first, number))
    if not deltas:
        return base
    rows = reduce(DataFrame.unionByName, [spark.read.schema(DELTA).parquet(p).withColumn("_k", F.lit(k)) for k, p in enumerate(deltas)])
    return merged(base, last_write(rows, ["path"], "_k", "md5", "ts", "content", "op"))


def watch(events: DataFrame, folder: str, edges_of: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], trigger: dict | None = None, compact: int = COMPACT) -> StreamingQuery:
    """Runs the increment for each micro-batch: ``sink(state, affected, batch)`` gets the merged files and what to redo.

    A batch's delta is written under ``folder`` by its number, so a repeated batch overwrites its own only; every ``compact``
    batches the state is written whole.
    """
    spark = events.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        state = state_before(spark, folder, number, compact)
        changes(batch, state).select("path", "md5", "ts", "content", "op").write.mode("overwrite").parquet(f"{folder}/delta-{number}")
        changed = spark.read.schema(DELTA).parquet(f"{folder}/delta-{number}")
        after = merged(state, changed)
        if (number + 1) % compact == 0:
            after.write.mode("overwrite").parquet(f"{folder}/state-{number}")
            after = spark.read.schema(STATE).parquet(f"{folder}/state-{number}")
        sink(after, affected(changed, edges_of(after)), number)

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
