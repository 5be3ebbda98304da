"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Bytes of rows that Spark sends to a Python worker at once, and the setting that holds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: The setting by which a query's shuffle files go as it ends.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a session whose executors are threads of the
    driver may leave it unset and gets a folder of its own; on a cluster executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return own_dir(spark.sparkContext.applicationId)


@cache
def own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"quillmesh-{application}-")


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files as they end. Else those stay until the driver collects its garbage, and
    the shuffles of all steps lie on disk at once. For queries that run once, as a query run again would have to shuffle again."""
    before = spark.conf.get(CLEAN_SETTING, None)
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SETTING)
        else:
            spark.conf.set(CLEAN_SETTING, before)


class Scratch:
    """Tables written to the shared folder, so that later steps survive lost executors.

    ``table`` writes and rereads a DataFrame, in folders by the columns ``by``, which come last then; nothing of its shuffles
    stays. Tables of whole texts are much smaller by the ``compression`` zstd. ``free`` deletes every table written so far but those named.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillmesh-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def table(self, df: DataFrame, name: str, by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        self.paths[name] = path
        with shuffles_end(self.spark):
            df.write.mode("overwrite").partitionBy(*by).parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *keep: str) -> None:
        for name in [n for n in self.paths if n not in keep]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_texts(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of about BATCH_BYTES: of whole texts, Spark's 10,000 rows are tens of MB for each task, held
    in the executor and in its worker. The setting has to stand when the result is run, so it stays in the session; a session
    that has a limit of its own keeps that."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def remainder(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def label_of_id(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all ids with a label; of repeated labels the largest counts."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return known.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, keep=None, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, those with the smallest id hashes.

    ``keep`` restricts the ids. The sample is bounded, so the small side is broadcast and texts don't move. With
    ``most_bytes`` it ends before the document whose text would exceed that in all.
    Rows without label, id or text are left out; of repeated labels the largest counts.
    """
    picked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if keep is not None:
        picked = picked.where(keep)
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked), "doc_id")
    if most_bytes is None:
        return sample
    sizes = sample.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).withColumn("order", F.xxhash64("doc_id"))
    before = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``bound`` rows at most
    fits = sizes.withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= most_bytes).select("doc_id")
    return sample.join(F.broadcast(fits), "doc_id", "left_semi")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it takes to be none of ``taken``, whatever their case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
