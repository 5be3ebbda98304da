"""The pipeline's stages, on null and repeated ids and against brute force on each stage's own input."""

import os
import re
import subprocess
import sys
import time
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from test_operators import MODEL, _components, _leaks, _stats

from quillmesh.llm.common import BATCH_BYTES, BATCH_SETTING, CLEAN_SETTING, Scratch, read, shared_dir
from quillmesh.llm.jaccard_join import jaccard_components
from quillmesh.llm.text_stats import text_stats
from quillmesh.llm.toxicity_cnn import WordBuckets, fit, word_ids

ROWS = "doc_id bigint, text string, row_key string"


def test_null_and_repeated_ids(spark, tmp_path):
    text = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    rows = [(4, text("a"), "x"), (4, text("a"), "x"), (9, text("a"), "y"), (None, text("a"), "z"), (None, text("b"), "z"), (None, text("b"), "z"), (5, text("c"), "x"), (5, text("d"), "x"), (2, "", "e"), (3, None, "e"), (1, text("a") + " new", "w")]
    docs = spark.createDataFrame(rows, ROWS)
    got = corpus_pipeline.ngram_jaccard(spark, docs, str(tmp_path))
    want = [(1, text("a") + " new", "w"), (2, "", "e"), (3, None, "e"), (5, text("c"), "x"), (5, text("d"), "x"), (None, text("b"), "z")]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    spark.createDataFrame([(1, text("b")), (2, text("d", 12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in rows if not (r[1] or "").startswith(("b0", "d0")))


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    model, stages = sentencepiece.SentencePieceProcessor(model_file=MODEL), [f for _, f in corpus_pipeline.STAGES]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    before = read(spark, sf, "documents")
    for k, stage in enumerate(stages):
        after = Scratch(spark).table(stage(spark, before, sf), "after")
        rows, got = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        texts = [(i, r.text) for i, r in rows.items()]
        assert len(rows) == before.count() and len(got) == after.count() > 0 and (k == 4 or all(rows[i] == r for i, r in got.items()))
        if k == 0:
            words, repeats = ({i: _stats(t)[j] for i, t in texts} for j in (0, 4))
            assert not [i for i in got if words[i] < 10 or 100 * repeats[i] > 20 * words[i]]
        elif k == 1:
            cnn, cuts = fit(before, read(spark, sf, "labels"))
            assert set(got) == {i for i, r in rows.items() if cnn.scores([word_ids(r.text, WordBuckets())], cnn.tables())[0] < cuts.get(r.lang, 0.5)}
        elif k == 2:
            assert set(got) == {i for i, (_, top) in _components(texts, 5, 80).items() if i == top}
        elif k == 3:
            parts = lambda t: {x for x in re.split(r"[^0-9a-z]+", (t or "").lower()) if len(x) > 3}
            near = [(d, j) for d in texts for j in items if 2 * len(parts(d[1]) & parts(j[1])) >= len(parts(j[1]))]
            assert set(got) == set(rows) - {i for d, j in near for i, _ in _leaks([d], [j])}
        else:
            assert set(got) == set(rows) and all(r.n_tokens == len(model.encode(rows[i].text or "", add_eos=True)) for i, r in got.items())
        before = after


def test_clashing_columns(spark, tmp_path):
    """Columns named as the stages name theirs, on odd rows: each stage but the last returns the columns of its input."""
    words = " ".join(f"a{k}" for k in range(40))
    rows = [(1, words, "en", True, "r", 1), (2, None, None, None, None, None), (None, words + " b", "de", False, "", 0), (3, "", "en", True, "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept boolean, rule string, Base_Failed int")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "none of this")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and 0 < got.count() <= 4
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_batches_of_long_texts_are_bounded(spark, tmp_path):
    """After a stage is planned, texts of 30 MB go to a worker a few MB at a time, and rules send them once, with the same rows."""
    rows = [(k, " ".join(f"w{k + j}" for j in range(1500)), "en") for k in range(3000)]
    docs = Scratch(spark).table(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1), "long")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.unset(BATCH_SETTING)
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert spark.conf.get(BATCH_SETTING) == str(BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    sent = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in sent) == len(rows) and max(r.size for r in sent) < 2 * BATCH_BYTES < sum(r.size for r in sent)
    assert sorted(map(tuple, kept.collect())) == rows
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"text#\d+ AS ", plan)) == 1, plan
    spark.conf.set(BATCH_SETTING, "9m")
    text_stats(docs, "doc_id")
    assert spark.conf.get(BATCH_SETTING) == "9m"
    spark.conf.unset(BATCH_SETTING)


def test_codec_returns_memory():
    """Pairs that are kept must not hold the memory of the chunks that are forgotten."""
    code = f"""
import gc, os
from quillmesh.llm.piece_codec import PieceCodec
held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
c, parts = PieceCodec({MODEL!r}), [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
words = [x + y + z for x in parts for y in parts for z in parts[::2]]
start = held()
for k in range(0, len(words), 50):
    c.round_trip(" ".join(words[k : k + 50]))
top, n, size, total = held(), (len(c.fits), len(c.fits.old)), c.fits.size, sum(k * (1 + v) for k, v in c.fits.items())
c.forget()
gc.collect()
print(start, top, held(), n)
assert (len(c.fits), len(c.fits.old)) == n and c.fits.size == size and total == sum(k * (1 + v) for k, v in c.fits.items()) and not c.seen
assert held() - start < 0.6 * (top - start)
"""
    assert subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}).returncode == 0


def test_tables_leave_no_shuffle(spark):
    """A written table's shuffle files go as it ends, without a collection of the driver's garbage; the session's setting stays."""
    folders = [Path(d.getPath()) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.glob("*/shuffle_*")}
    old = files()
    counts = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    assert Scratch(spark).table(counts.join(counts.withColumnRenamed("count", "c"), "k"), "counts").count() == 5000
    small, end = 2000, time.time() + 20  # a count's own shuffle is a row for each task
    while (left := sum(f.stat().st_size for f in files() - old if f.exists())) > small and time.time() < end:
        time.sleep(0.2)
    assert left <= small
    assert spark.conf.get(CLEAN_SETTING, None) in (None, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    Scratch(spark).table(counts, "counts")
    assert spark.conf.get(CLEAN_SETTING) == "true"
    spark.conf.unset(CLEAN_SETTING)


def test_near_duplicates_leave_few_tables(spark, tmp_path):
    """Of what the stage writes, only rows and what is small stay; an id with several texts is one node, though its sets have numbers of their own."""
    text = lambda c, *gone: " ".join(f"{c}{k}" for k in range(200) if k not in gone)
    rows = [(10 * g + j, text(f"t{g}x", *range(j)), "") for g in range(40) for j in range(3)]
    rows += [(900, text("p"), ""), (900, text("q"), ""), (901, text("p", 3), ""), (902, text("q", 5), ""), (903, text("p", *range(100)), "")]
    docs = Scratch(spark).table(spark.createDataFrame(rows, ROWS), "docs")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = corpus_pipeline.ngram_jaccard(spark, docs, str(tmp_path))
    left = {t.name for d in set(folder.iterdir()) - before for t in d.iterdir()}
    assert left == {"rows", "gone", "every", *(t for t in left if t.startswith("parts"))} and len(left) == 4
    assert sorted(r.doc_id for r in got.collect()) == [*range(0, 400, 10), 900, 900, 903]
    nodes = {r.doc_id: r.component_id for r in jaccard_components(docs.where("doc_id >= 900"), width=5, percent=80).collect()}
    assert nodes == {900: 900, 901: 900, 902: 900, 903: 903}
