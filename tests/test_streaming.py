"""Incremental analysis over a small file stream."""

import pytest

from quillmesh.plans.code_rules import import_cycles
from quillmesh.sources.code_facts import imports, module_edges
from quillmesh.streaming.incremental import state_before, watch

EVENTS = "ts timestamp, path string, op string, content string"


@pytest.mark.parametrize("compact", [2, 20])
def test_watch(spark, tmp_path, compact):
    import datetime as dt

    seen = []
    edges = lambda s: module_edges(imports(s), s)

    def sink(state, hit, number):
        seen.append((sorted(r.path for r in hit.collect()), len(import_cycles(state).collect())))

    def step(*rows):
        now = dt.datetime(2024, 1, 1, 0, 0, len(seen))
        spark.createDataFrame([(now, p, op, c) for p, op, c in rows], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watch(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), edges, sink, compact=compact).awaitTermination()

    step(("/a.ts", "change", "import {b} from './b'"), ("/b.ts", "change", "1"), ("/c.ts", "change", "import {a} from './a'"))
    step(("/b.ts", "change", "import {c} from './c'"))
    step(("/b.ts", "change", "import {c} from './c'"))
    step(("/c.ts", "unlink", None))
    assert seen == [(["/a.ts", "/b.ts", "/c.ts"], 0), (["/a.ts", "/b.ts", "/c.ts"], 1), ([], 1), (["/c.ts"], 0)]
    assert sorted(r.path for r in state_before(spark, str(tmp_path / "out"), 4, compact).collect()) == ["/a.ts", "/b.ts"]
