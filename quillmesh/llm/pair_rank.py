"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Pairs of one document marked good and one marked bad teach a linear score by logistic loss on the difference of their
features. All labelled documents teach: they are dealt into shards, each shard learns weights from its pairs, and the weights
are averaged by the shards' sizes. The raw score is cut at the quantile of training scores that the share of good documents gives, and squashed so that
this cut lies at the stated threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, label_of_id
from quillmesh.llm.text_stats import RATIOS, measure

#: Labelled documents of one shard, roughly, and pairs drawn from them; every labelled document is in a shard.
SHARD, PAIRS = 12_000, 60_000
#: Ratios that don't follow a text's length.
FEATURES = [r for r in RATIOS if r not in ("distinct_share", "log_words")]
_AT = [RATIOS.index(f) for f in FEATURES]


def features(text: str | None) -> list[float]:
    counts, ratios = measure(text)
    return [*(ratios[i] for i in _AT), float(counts[0] < 10)]


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their square roots, so that small shares count."""
    return np.hstack([x, np.sqrt(np.abs(x))])


def weights(z: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> np.ndarray:
    """Weights of scaled features by logistic loss on pairs, one good and one bad, by gradient steps with momentum."""
    rng = np.random.default_rng(seed)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    diff = z[a] - z[b]
    w, velocity = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + 1e-3 * w
        velocity = 0.9 * velocity - 0.5 * grad
        w = w + velocity
    return w


class PairRank:
    """A learned scorer. Without documents of both kinds it scores all alike, at the share of good ones."""

    def __init__(self, x: np.ndarray, good: np.ndarray, threshold: float, pairs: int = PAIRS, seed: int = 7):
        self.threshold = threshold
        width = expand(np.zeros((1, len(FEATURES) + 1))).shape[1]
        self.w, self.mean, self.std, self.scale = np.zeros(width), np.zeros(width), np.ones(width), 1.0
        share = float(good.mean()) if len(good) else 1.0
        self.cut = 0.0 if share >= 0.5 else 1e9
        if not good.any() or good.all():
            return
        z = expand(x)
        self.mean, self.std = z.mean(0), z.std(0) + 1e-6
        z = self.scaled(x)
        self.w = weights(z, good, pairs, seed)
        raw = z @ self.w
        # the quantile of the score that the share of good documents gives, at the middle of the gap around it
        order = np.sort(raw)
        k = int(np.clip((~good).sum(), 1, len(order) - 1))
        self.cut = (order[k - 1] + order[k]) / 2
        self.scale = max(float(np.std(raw)), 1e-6)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.std, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        shift = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(4 * (z @ self.w - self.cut) / self.scale + shift, -35, 35)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES) + 1)


def neighbours(rows: DataFrame, value: str, k: int) -> tuple[float, float]:
    """The values at the places k - 1 and k, from 0, of all rows in order, exactly: bins are counted, and the one that holds both
    places is cut again, so that no task and not the driver holds the rows. There are more than k rows and k is at least 1."""
    v, before = F.col(value), 0
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        step = (high - low) / 4096
        bins = F.least(F.floor((v - F.lit(low)) / F.lit(step)), F.lit(4095)) if step else F.when(v > F.lit(low), 1).otherwise(0)
        found = sorted(rows.where(v.between(low, high)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect(), key=lambda r: r.lo)
        ends = before + np.cumsum([r.n for r in found])
        a, b = (int(np.searchsorted(ends, at, side="right")) for at in (k - 1, k))
        if a != b:
            return found[a].hi, found[b].lo
        low, high, before = found[a].lo, found[a].hi, int(ends[a]) - found[a].n
    return low, low


def fit(taught: DataFrame, threshold: float = 0.7, shard: int = SHARD) -> PairRank:
    """Learns from all rows of ``taught(doc_id, y, x)``. Moments, quantile and spread are those of all rows; a shard's pairs are drawn
    from the shard. Only sums and weights reach the driver. What is learnt is rounded, as sums vary in their last digits."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, good = expand(_matrix(b.column("x"))), b.column("y").to_numpy() > 0
            got = np.concatenate([[len(z), good.sum()], z.sum(0), (z * z).sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], names=["at", "part"])

    model = PairRank(np.empty((0, len(FEATURES) + 1)), np.empty(0, bool), threshold)
    total = {r["at"]: r["s"] for r in taught.mapInArrow(sums, "at int, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()}
    n, good = int(total.get(0, 0)), int(total.get(1, 0))
    if not 0 < good < n:
        model.cut = 0.0 if not n or good else 1e9
        return model
    width = len(model.mean)
    of = lambda first: np.array([total[first + k] for k in range(width)])
    model.mean = np.round(of(2) / n, 9)
    model.std = np.round(np.sqrt(np.maximum(of(2 + width) / n - (of(2) / n) ** 2, 0)), 9) + 1e-6

    def learn(rows: pa.Table) -> pa.Table:
        x, kind = _matrix(rows["x"].combine_chunks()), rows["y"].to_numpy() > 0
        order = np.lexsort([*x.T, kind])
        x, kind = x[order], kind[order]
        w = weights(model.scaled(x), kind) if 0 < kind.sum() < len(kind) else np.empty(0)
        return pa.table({"shard": rows["shard"][:1], "n": pa.array([len(x)], pa.int64()), "w": pa.array([w], pa.list_(pa.float64()))})

    shards = -(-n // shard)
    dealt = taught.select(F.pmod(F.xxhash64("doc_id", "x"), F.lit(shards)).alias("shard"), "y", "x")
    learnt = sorted(r for r in dealt.groupBy("shard").applyInArrow(learn, "shard bigint, n bigint, w array<double>").collect() if r.w)
    if not learnt:
        model.cut = 0.0 if 2 * good >= n else 1e9
        return model
    model.w = np.round(np.average([r.w for r in learnt], axis=0, weights=[r.n for r in learnt]), 9)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.scaled(_matrix(b.column("x"))) @ model.w)], names=["raw"])

    scores = taught.select("x").mapInArrow(raw, "raw double")
    below, above = neighbours(scores, "raw", int(np.clip(n - good, 1, n - 1)))
    model.cut = (below + above) / 2
    model.scale = max(round(scores.agg(F.stddev_pop("raw")).first()[0], 9), 1e-6)
    return model


def rank_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, label: str = "quality", shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; labels of held-out ids are never learnt from, all others are.

    Null and empty texts are scored from zero features; a null id counts as the empty text when folds are dealt; repeated rows
    score alike; empty tables give no rows; other columns are ignored, and none but the text enters the score. Texts are read
    once and don't move: their features are written to the shared folder, joined with the labels and scored from there. Rows
    without label, id or text teach nothing; of repeated labels the largest counts.
    """
    scratch = Scratch(docs.sparkSession)
    fold = f"crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % {folds}"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            x = pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), texts.is_valid(), x], names=["doc_id", "held_out", "has_text", "x"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(f"{fold} = {held}").alias("held_out"))
    rows = scratch.table(rows.mapInArrow(measured, "doc_id bigint, held_out boolean, has_text boolean, x array<double>"), "features")
    taught = rows.where("has_text and not held_out").join(label_of_id(labels, label), "doc_id").select("doc_id", "y", "x")
    model = fit(scratch.table(taught, "taught"), threshold, shard)
    scratch.free("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
