"""Running sets and sessions where one key has all rows: the same rows as from plain windows, spread over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import relational as rel

NOW = dt.datetime(2024, 1, 1)


def events(spark, seed, keys):
    rng = random.Random(seed)
    rows, at = [], NOW
    for k in range(1500):
        at += dt.timedelta(seconds=rng.choice([1, 1, 5, 60, 61, 600]))
        rows.append((rng.choice(keys), k, at, rng.choice([None, *map(str, range(40))])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, id int, ts timestamp, v string")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("keys", [["hot"], ["hot"] * 9 + ["a", "b", None], [f"k{i}" for i in range(400)]])
def test_blocks_change_no_row(spark, keys):
    df = events(spark, len(keys), keys)
    assert rows(rel.running_set(df, "k", ["ts", "id"], "v", most=50)) == rows(rel.running_set(df, "k", ["ts", "id"], "v"))
    assert rows(rel.sessions(df, "k", "ts", "1 minutes", ["ts", "id"], most=50)) == rows(rel.sessions(df, "k", "ts", "1 minutes", ["ts", "id"]))
    assert rows(rel.two_tier(df, "k", "v", "ts", "1 minutes", "5 minutes", most=50)) == rows(rel.two_tier(df, "k", "v", "ts", "1 minutes", "5 minutes"))


def test_rows_alike_count_once(spark):
    df = spark.createDataFrame([("hot", 1, "a"), ("hot", 1, "a"), ("hot", 1, "b"), ("hot", 2, "b"), ("hot", 3, None), ("hot", 4, None)] * 3, "k string, id int, v string")
    assert {r.seen for r in rel.running_set(df, "k", ["id"], "v", most=2).where("id = 4").collect()} == {3}


def test_one_key_is_spread(spark):
    df = events(spark, 1, ["hot"])
    sizes = [r.n for r in rel.blocked(df, "k", ["ts", "id"], blocks=8).groupBy("_block").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 500
    spread = rel.running_set(df, "k", ["ts", "id"], "v", most=50).withColumn("task", F.spark_partition_id())
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spread.count() == 1500
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.splitlines() if "Window" in line and "_n#" not in line and "_before#" not in line)


def test_empty(spark):
    df = events(spark, 1, ["a"]).limit(0)
    assert rel.running_set(df, "k", ["ts"], "v").count() == rel.sessions(df, "k", "ts", "1 minutes", ["ts"]).count() == 0
