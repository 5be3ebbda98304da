"""Put-off runs, the change filter and the folder source as streams, with restarts."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.relational import two_tier
from quillmesh.sources.tree_watch import TreeWatch
from quillmesh.streaming.keyed import changes_only, merged_in, put_off

NOW = dt.datetime(2024, 1, 1)
CLICKS = "ts timestamp, path string, project string"
EVENTS = "ts timestamp, path string, op string, content string"


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, folder, name):
    """Runs the stream over what is there; returns all rows written so far."""
    df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start(f"{folder}/{name}").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").collect()


@pytest.mark.parametrize("seed", range(3))
def test_bursts_are_the_same_in_any_order(seed):
    rng = random.Random(seed)
    times = [rng.randint(0, 500) for _ in range(80)]
    want = []
    for t in sorted(times):
        if want and t <= want[-1][1] + 5:
            want[-1] = [want[-1][0], t, want[-1][2] + 1]
        else:
            want.append([t, t, 1])
    bursts = []
    for t in times:
        merged_in(bursts, t, 5)
    assert bursts == want


def test_replay_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    clicks, at = [], NOW
    for _ in range(300):
        at += dt.timedelta(milliseconds=rng.choice([1, 10, 99, 100, 101, 400, 1000, 1001, 5000]))
        clicks.append((at, f"f{rng.randint(0, 5)}", "big" if rng.random() < 0.7 else "small"))
    end = [(at + dt.timedelta(hours=1), "end", "end")]
    (tmp_path / "in").mkdir()
    stream = put_off(spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "path", "project", "ts", late="2 seconds")
    for k in range(0, 300, 100):
        part = clicks[k : k + 100]
        swapped = [part[i + 1] if i % 2 == 0 and i + 1 < len(part) and (part[i + 1][0] - part[i][0]).total_seconds() < 1 else c for i, c in enumerate(part)]
        add(spark, tmp_path / "in", part if len(set(swapped)) != len(part) else swapped, CLICKS)
        run(stream, tmp_path, "out")  # a restart from the checkpoint each time
    add(spark, tmp_path / "in", end, CLICKS)
    run(stream, tmp_path, "out")
    add(spark, tmp_path / "in", [(end[0][0] + dt.timedelta(seconds=1), None, "end")], CLICKS)
    got = {(r.tier, r.key, r.start, r.n) for r in run(stream, tmp_path, "out") if r.key != "end"}
    batch = two_tier(spark.createDataFrame(clicks, CLICKS), "path", "project", "ts", "100 milliseconds", "1000 milliseconds")
    want = {(r.tier, r.key, r.start, r.n) for r in batch.collect()}
    assert got == want and len(want) > 100


def test_runs_are_put_off_by_the_clock(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = put_off(spark.readStream.schema(CLICKS).parquet(str(tmp_path / "in")), "path", "project", "ts", fast=200, slow=6000)
    query = stream.writeStream.format("memory").queryName("put_off").trigger(processingTime="200 milliseconds").start()
    try:
        for k in range(3):
            add(spark, tmp_path / "in", [(NOW + dt.timedelta(seconds=k), "a", "p"), (NOW, f"b{k}", "p"), (NOW, None, "p")], CLICKS)
            time.sleep(1)
        for _ in range(120):
            time.sleep(0.5)
            rows = spark.table("put_off").collect()
            if any(r.tier == 2 for r in rows):
                break
    finally:
        query.stop()
    projects = [(r.key, r.n) for r in rows if r.tier == 2]
    assert projects == [("p", 9)]  # one run over the project, however many events put it off
    assert sum(r.n for r in rows if r.key == "a") == 3 and sorted(r.key for r in rows if r.key.startswith("b")) == ["b0", "b1", "b2"]


def test_changes_pass_and_repeats_do_not(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = changes_only(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    at = lambda s: NOW + dt.timedelta(seconds=s)
    steps = [
        [(at(1), "/a", "change", "A"), (at(2), "/b", "change", None)],
        [(at(3), "/a", "change", "A"), (at(4), "/b", "change", "")],
        [(at(6), "/a", "change", "A"), (at(5), "/a", "change", "B"), (at(7), "/c", "unlink", None)],
        [(at(8), "/a", "unlink", None), (at(8), "/b", "change", "b"), (at(9), "/b", "change", "b"), (None, "/b", "change", "x"), (at(9), None, "change", "x")],
        [(at(10), "/a", "change", "A")],
    ]
    seen = []
    for rows in steps:
        add(spark, tmp_path / "in", rows, EVENTS)
        before = len(seen)
        seen = sorted(run(stream, tmp_path, "out"), key=lambda r: (r.ts, r.path))
        assert len(seen) - before in (0, 1, 2)
    assert [(r.path, r.ts.second, r.op, r.version, r.content) for r in seen] == [
        ("/a", 1, "change", 1, "A"), ("/b", 2, "change", 1, None), ("/a", 5, "change", 2, "B"), ("/a", 6, "change", 3, "A"), ("/a", 8, "unlink", 4, None), ("/b", 8, "change", 2, "b"), ("/a", 10, "change", 5, "A"),
    ]


def test_folder_source_logs_and_replays(spark, tmp_path):
    spark.dataSource.register(TreeWatch)
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    options = {"path": str(root), "log": str(tmp_path / "log")}
    stream = spark.readStream.format("tree_watch").options(**options).load()

    def write(name, text):
        (root / name).write_text(text)
        os.utime(root / name, ns=(time.time_ns(), time.time_ns()))

    def ops(df=stream, name="seen"):
        return sorted((os.path.basename(r.path), r.op, r.content) for r in run(df, tmp_path, name))

    write("src/a.ts", "1")
    write("src/b.tsx", "2")
    write("src/note.txt", "no")
    write("node_modules/c.ts", "no")
    assert ops() == [("a.ts", "add", "1"), ("b.tsx", "add", "2")]
    assert len(ops()) == 2  # nothing new: nothing logged
    write("src/a.ts", "11")
    (root / "src/b.tsx").unlink()
    write("src/d.js", "3")
    want = sorted([("a.ts", "add", "1"), ("b.tsx", "add", "2"), ("a.ts", "change", "11"), ("b.tsx", "unlink", None), ("d.js", "add", "3")], key=str)
    assert sorted(ops(), key=str) == want
    replay = [(r.path.rsplit("/", 1)[1], r.op) for r in run(spark.readStream.format("tree_watch").options(**options).load(), tmp_path, "again")]  # another query, from the log's start
    assert sorted(replay) == sorted(x[:2] for x in want)
    through = changes_only(spark.readStream.format("tree_watch").options(**options).load())
    assert {(os.path.basename(r.path), r.op) for r in run(through, tmp_path, "changes")} >= {("d.js", "add"), ("b.tsx", "unlink")}
    with pytest.raises(Exception, match="log"):
        run(spark.readStream.format("tree_watch").option("path", str(root)).load().select(F.col("path")), tmp_path, "bad")
