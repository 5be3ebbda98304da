"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words and word beginnings are hashed into an embedding table and added up; filters of one, two and three words slide over the whole text, each keeps its
maximum, and a logistic layer turns the maxima into a score. All labelled documents teach: they are dealt into shards, each shard
learns for a turn from where the last one ended, and what the shards changed is averaged. A filter is linear, so scoring adds rows of premultiplied tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, label_of_id, map_texts, remainder

#: Labelled documents and words of one shard, roughly: a task holds eight bytes for each word. Every one is in a shard.
SHARD, SHARD_WORDS = 6_000, 8 << 20
#: Bits of the filter of labelled ids, and turns of learning.
SLOTS, EPOCHS = 1 << 25, 4
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 6, (1, 2, 3)
#: Lower case for A-Z, white space for other ASCII but letters and digits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class WordBuckets(dict):
    """Buckets of a word and of its first four and six bytes, packed; an inflected word shares the latter with its kin.

    ``most`` words of up to 64 bytes are remembered, about 10 MB, while a partition is read.
    """

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        got = crc32(word) % BUCKETS | crc32(b"4" + word[:4]) % BUCKETS << 16 | crc32(b"6" + word[:6]) % BUCKETS << 32
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


def word_ids(text: str | None, buckets: WordBuckets) -> np.ndarray:
    """One packed bucket triple for each word of the whole text."""
    return np.array([buckets[w] for w in (text or "").encode("utf-8", "replace").translate(FOLD).split()], np.int64)


def unpacked(ids: np.ndarray) -> np.ndarray:
    return np.stack([ids & 0xFFFF, ids >> 16 & 0xFFFF, ids >> 32 & 0xFFFF])


def word_counts(texts: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each bucket stands, and in how many toxic ones."""
    seen, toxic = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for ids, t in zip(texts, y, strict=True):
        u = np.unique(unpacked(ids))
        seen[u] += 1
        toxic[u] += t
    return seen, toxic


class TextCnn:
    """Bucket ``BUCKETS`` pads: texts shorter than a filter, and the empty text, are padded up to it."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
        self.table[:, 0] = 0
        self.table[BUCKETS] = 0
        self.filters = {w: rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w, f in self.filters.items():
            f[::DIM, : FILTERS // 2] = np.abs(f[::DIM, : FILTERS // 2]) + 0.5 / w
        self.out = rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias, self.shift = -1.0, 0.0

    @staticmethod
    def padded(ids: np.ndarray) -> np.ndarray:
        return np.concatenate([ids, np.full(max(0, WIDTHS[-1] - len(ids)), BUCKETS | BUCKETS << 16 | BUCKETS << 32, np.int64)])

    def begin(self, seen: np.ndarray, toxic: np.ndarray, base: float) -> bool:
        """Starts one embedding dimension at each bucket's smoothed log odds; false if all labels are alike."""
        if not 0 < base < 1:
            self.bias = -20.0 if base == 0 else 20.0
            self.out[:] = 0
            return False
        self.table[:BUCKETS, 0] = np.clip(np.log((toxic + 8 * base) / (seen + 8) / base), -1, 3)[:BUCKETS] / 2
        self.adagrad = {k: np.full_like(v, 1e-2) for k, v in {"table": self.table, "out": self.out, **self.filters}.items()}
        self.bias2 = 1e-2
        return True

    def learn(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> None:
        """All turns over texts that are held at once."""
        rng = np.random.default_rng(3)
        if self.begin(*word_counts(texts, y), float(y.mean())):
            for _ in range(epochs):
                self.turn(texts, y, float(y.mean()), rng)

    def turn(self, texts: list[np.ndarray], y: np.ndarray, base: float, rng: np.random.Generator, rate: float = 0.05) -> None:
        """One turn over the texts, by Adagrad."""
        weight = np.where(y == 1, 0.5 / base, 0.5 / (1 - base)).astype(np.float32)
        for k in rng.permutation(len(texts)):
            ids = unpacked(self.padded(texts[k]))
            rows = self.table[ids].sum(0)
            h, at, seen_rows = [], [], []
            for w, f in self.filters.items():
                n = len(rows) - w + 1
                conv = sum(rows[j : j + n] @ f[j * DIM : (j + 1) * DIM] for j in range(w))
                best = conv.argmax(0)
                at.append(best)
                h.append(conv[best, np.arange(FILTERS)])
                seen_rows.append(np.hstack([rows[best + j] for j in range(w)]))
            hidden = np.maximum(np.concatenate(h), 0)
            p = 1 / (1 + np.exp(-np.clip(float(hidden @ self.out) + self.bias, -30, 30)))
            g = (p - y[k]) * weight[k]
            back = (g * self.out) * (hidden > 0)
            grad = g * hidden + 1e-5 * self.out
            self.adagrad["out"] += grad * grad
            self.out -= rate * grad / np.sqrt(self.adagrad["out"])
            self.bias2 += g * g
            self.bias -= rate * g / self.bias2**0.5
            for i, (w, f) in enumerate(self.filters.items()):
                b = back[i * FILTERS : (i + 1) * FILTERS]
                if not b.any():
                    continue
                grad = seen_rows[i].T * b + 1e-5 * f
                pull = (f * b).T.reshape(FILTERS, w, DIM)
                self.adagrad[w] += grad * grad
                f -= rate * grad / np.sqrt(self.adagrad[w])
                for j in range(w):
                    to = ids[:, at[i] + j]
                    np.add.at(self.adagrad["table"], to, pull[:, j] ** 2)
                    np.add.at(self.table, to, -rate * pull[:, j] / np.sqrt(self.adagrad["table"][to]))
            self.table[BUCKETS] = 0

    def state(self) -> np.ndarray:
        """All that is learnt, with Adagrad's sums: a row for each bucket, then rows of the other weights."""
        rest = [self.out, *self.filters.values(), self.adagrad["out"], *(self.adagrad[w] for w in WIDTHS), np.array([self.bias, self.bias2])]
        rest = np.concatenate([x.ravel() for x in rest]).astype(np.float64)
        return np.vstack([np.hstack([self.table, self.adagrad["table"]]), np.pad(rest, (0, -len(rest) % (2 * DIM))).reshape(-1, 2 * DIM)])

    def restore(self, state: np.ndarray) -> None:
        rows, rest = state[: BUCKETS + 1].astype(np.float32), state[BUCKETS + 1 :].ravel()
        self.table[:], self.adagrad["table"][:] = rows[:, :DIM], rows[:, DIM:]
        for x in [self.out, *self.filters.values(), self.adagrad["out"], *(self.adagrad[w] for w in WIDTHS)]:
            x[:] = rest[: x.size].reshape(x.shape)
            rest = rest[x.size :]
        self.bias, self.bias2 = float(rest[0]), float(rest[1])

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        return {(w, j): self.table @ f[j * DIM : (j + 1) * DIM] for w, f in self.filters.items() for j in range(w)}

    def scores(self, texts: list[np.ndarray], tables: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """200 texts at a time: joined, each filter's windows that lie in one text, and the maximum by text."""
        if not texts:
            return np.empty(0)
        if len(texts) > 200:
            return np.concatenate([self.scores(texts[k : k + 200], tables) for k in range(0, len(texts), 200)])
        texts = [self.padded(t) for t in texts]
        ids, sizes = unpacked(np.concatenate(texts)), np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        hidden = []
        for w in WIDTHS:
            conv = sum(tables[w, 0][x] for x in ids)
            for j in range(1, w):
                conv[:-j] += sum(tables[w, j][x[j:]] for x in ids)
            for j in range(1, w):
                conv[ends - j] = -np.inf
            hidden.append(np.maximum.reduceat(conv, starts, axis=0))
        logit = np.maximum(np.hstack(hidden), 0) @ self.out + self.bias + self.shift
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -35, 35)))


def best_cut(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The score at the middle of the gap that gives the largest F1; 0.5 without rows of both kinds. ``score`` may stand for
    ``n`` rows each, ``y`` of them toxic."""
    n = np.ones(len(score)) if n is None else n
    if not y.any() or y.sum() == n.sum():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


def _texts(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, lang, ids, tie, y) of all documents of ``known(doc_id, y)``. A bounded filter of their ids is looked up first,
    so that hardly any other text is read into words and moved; the join behind it is exact, and alike at every size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    mask = np.zeros(SLOTS // 8, np.uint8)
    for r in known.select(slot.alias("h")).groupBy(F.expr("h div 32768").alias("b")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("m")).collect():
        mask[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.m, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for whole in batches:
            h = whole.column("slot").to_numpy()
            whole = whole.filter(pa.array((mask[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                ids = [word_ids(x, buckets) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(ids, pa.list_(pa.int64())), pa.array([crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "lang", "ids", "tie"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return map_texts(rows.withColumn("slot", slot), run, "doc_id bigint, lang string, ids array<bigint>, tie bigint").join(known.hint("merge"), "doc_id")


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of one shard, as shards lie one behind the other, in an order that doesn't depend on tasks."""
    held, shard = [], None
    for b in batches:
        number = b.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            if end > at and held and number[at] != shard:
                yield _ordered(held)
                held = []
            if end > at:
                held.append(b.slice(at, end - at))
                shard = number[at]
    if held:
        yield _ordered(held)


def _ordered(held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("y", "ascending")]).combine_chunks()


def fit(docs: DataFrame, labels: DataFrame, keep=None, label: str = "toxic", shard: int = SHARD) -> tuple[TextCnn, dict[str, float]]:
    """The model and a threshold for each language, learnt from all labelled documents that ``keep`` admits.

    A fifth of them sets the score's 0.5 and the thresholds, by counts of scores in steps of 0.01 of the logit; a language with
    few toxic documents keeps 0.5. Only counts by bucket and averaged weights reach the driver. What a turn changes is averaged
    over the shards that changed it, and rounded, as sums vary in their last digits. Rows without label, id or text teach nothing.
    """
    scratch = Scratch(docs.sparkSession)
    known = label_of_id(labels, label)
    known = scratch.table(known if keep is None else known.where(keep), "labels")
    taught = _labelled(docs, known).select("*", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) != 0).alias("teach"))
    taught = scratch.table(taught, "taught")
    rows, model = taught.where("teach"), TextCnn()
    n, words, toxic = rows.agg(F.count("*"), F.sum(F.size("ids")), F.count_if(F.col("y") > 0)).first()
    if not n:
        model.bias, model.out[:] = -20.0, 0
        scratch.free()
        return model, {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hits = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for b in batches:
            more = word_counts(_texts(b.column("ids")), (b.column("y").to_numpy() > 0).astype(np.float64))
            seen, hits = seen + more[0], hits + more[1]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), pa.array(hits[at])], names=["at", "seen", "hits"])

    seen, hits = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in rows.select("ids", "y").mapInArrow(count, "at int, seen double, hits double").groupBy("at").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).collect():
        seen[r["at"]], hits[r["at"]] = r.seen, r.hits
    base = toxic / n
    shards = max(-(-n // shard), -(-words // SHARD_WORDS))
    # a folder and a file each shard, so that turns read them whole and move none; more than a row group learns as two shards
    dealt = rows.select("doc_id", "tie", "y", "ids", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)).alias("shard"))
    dealt = scratch.table(dealt.repartition(shards, "shard"), "dealt", ("shard",))
    columns = [f"d{k}" for k in range(2 * DIM)]

    def learner(start: np.ndarray, turn: int):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in shards_of(batches):
                own = TextCnn()
                own.begin(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), base)
                own.restore(start)
                own.turn(_texts(part["ids"].chunk(0)), (part["y"].to_numpy() > 0).astype(np.float64), base, np.random.default_rng(3 + turn))
                change = own.state() - start
                at = np.flatnonzero(change.any(1))
                yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(np.full(len(at), float(len(part)))), **{c: pa.array(change[at, k] * len(part)) for k, c in enumerate(columns)}})

        return learn

    for turn in range(EPOCHS if model.begin(seen, hits, base) else 0):
        start = model.state()
        parts = dealt.mapInArrow(learner(start, turn), f"at int, n double, {', '.join(f'{c} double' for c in columns)}")
        mean = parts.groupBy("at").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in columns)).toPandas()
        start[mean["at"].to_numpy()] += np.round(mean[columns].to_numpy(), 9)
        model.restore(start)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for b in batches:
            s = model.scores(_texts(b.column("ids")), tables)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(np.floor(100 * np.log(s / (1 - s))).astype(np.int32))], names=["lang", "y", "bin"])

    held = taught.where("not teach").select("lang", "y", "ids").mapInArrow(judge, "lang string, y int, bin int")
    held = held.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("y")).orderBy("lang", "bin").toPandas()
    scratch.free()
    logit, y, many, lang = (held["bin"].to_numpy() + 0.5) / 100, held["y"].to_numpy(float), held["n"].to_numpy(float), held["lang"].to_numpy()
    whole = held.groupby("bin", as_index=False)[["n", "y"]].sum()
    cut = best_cut(1 / (1 + np.exp(-(whole["bin"].to_numpy() + 0.5) / 100)), whole["y"].to_numpy(float), whole["n"].to_numpy(float))
    model.shift = -float(np.log(cut / (1 - cut)))
    score = 1 / (1 + np.exp(-(logit + model.shift)))
    cuts = {str(x): float(np.clip(best_cut(score[lang == x], y[lang == x], many[lang == x]), 0.25, 0.75)) for x in sorted(set(lang)) if x and y[lang == x].sum() >= 8}
    return model, cuts


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged for each row of ``docs``; labels of held-out ids are never learnt from.

    ``predicted`` is score >= 0.5; ``flagged`` compares the score with the threshold of the row's language, 0.5 where none
    is known. Only the text enters the score. Null and empty texts are padding and get a score as well; a null id counts as
    the empty text when folds are dealt; repeated rows score alike; empty tables give no rows; other columns are ignored.
    """
    model, cuts = fit(docs, labels, remainder("doc_id", folds) != held, shard=shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, buckets = model.tables(), WordBuckets()
        for b in batches:
            s = np.concatenate([np.empty(0)] + [model.scores([word_ids(x, buckets) for x in b.column("text").slice(k, 200).to_pylist()], tables) for k in range(0, b.num_rows, 200)])
            limit = np.array([cuts.get(x, 0.5) for x in b.column("lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)],
                names=["doc_id", "held_out", "score", "predicted", "flagged"],
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), (remainder("doc_id", folds) == held).alias("held_out"))
    return map_texts(rows, run, "doc_id bigint, held_out boolean, score double, predicted int, flagged boolean")


def filter_toxic(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` whose score lies below the threshold of their language, with all columns, without a shuffle."""
    model, cuts = fit(docs, labels, shard=shard)
    lang = docs.columns.index("lang") if "lang" in docs.columns else None
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, buckets = model.tables(), WordBuckets()
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                b = whole.slice(start, 200)
                s = model.scores([word_ids(x, buckets) for x in b.column(at).to_pylist()], tables)
                limit = [cuts.get(x, 0.5) for x in b.column(lang).to_pylist()] if lang is not None else [0.5] * b.num_rows
                yield b.filter(pa.array(s < np.array(limit)))

    return map_texts(docs, run, docs.schema)
