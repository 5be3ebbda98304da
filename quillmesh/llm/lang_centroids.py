"""Language identification by nearest centroids: cosine of normalised TF-IDF vectors of letter n-grams with a few clustered
centroids per language. Texts farther from the nearest centroid than almost all of its own training texts are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import remainder

#: Hashed n-grams are dealt over so many dimensions.
DIMENSIONS = 1 << 13
LONGEST = 4
#: Languages at most, the most frequent ones, and for each training texts at most, by hash: what a training task holds.
LANGUAGES, TEXTS = 256, 800
CENTROIDS = 4
#: Code points of a text that are turned into n-grams at once.
SLICE = 1 << 19
#: Share of a centroid's own training texts that lie within its radius.
WITHIN = 0.995
#: How far apart similarities must be for a score of e to 1.
SHARPNESS = 0.05
UNKNOWN = "und"


class Grams:
    """Counts of hashed n-grams of 1 to LONGEST letters; whatever is no letter, and each end of a text, is one gap."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(0x32400)], bool)  # no letters lie beyond
        rng = np.random.default_rng(7)
        self.factor = rng.integers(1, 2**62, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def counts(self, text: str | None) -> np.ndarray | None:
        """None if the text has no letters. Long texts go by slices that overlap, each n-gram counting where it ends."""
        if not text:
            return None
        total, seen, before = np.zeros(DIMENSIONS, np.int64), False, np.zeros(1, np.uint64)
        for at in range(0, len(text), SLICE):
            codes = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            known = codes < len(self.letter)
            codes = np.where(known & self.letter[np.where(known, codes, 0)], codes, 0).astype(np.uint64)
            seen = seen or bool(codes.any())
            if at + SLICE >= len(text):
                codes = np.append(codes, np.uint64(0))
            whole = np.concatenate([before, codes])
            fresh = np.arange(len(whole)) >= len(before)
            stay = np.ones(len(whole), bool)
            stay[1:] = (whole[1:] > 0) | (whole[:-1] > 0)
            whole, fresh = whole[stay], fresh[stay]
            h = np.zeros(len(whole), np.uint64)
            for k in range(LONGEST):
                if len(whole) <= k:
                    break
                h = (h[: len(whole) - k] + (whole[k:] + np.uint64(k + 1)) * self.factor[k]) if k else (whole + np.uint64(1)) * self.factor[0]
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                place = (mixed >> np.uint64(65 - DIMENSIONS.bit_length())).astype(np.int64)
                keep = fresh[k:] if k else fresh & (whole > 0)
                total += np.bincount(place[keep], minlength=DIMENSIONS)
            before = whole[-(LONGEST - 1) :]
        return total if seen else None

    def vector(self, text: str | None, idf: np.ndarray) -> np.ndarray | None:
        """The text's TF-IDF vector of length 1, with logarithmic frequencies; None if the text has no letters."""
        n = self.counts(text)
        if n is None:
            return None
        v = np.log1p(n).astype(np.float32) * idf
        size = float(np.sqrt(v @ v))
        return v / size if size else None


def _learnable(docs: DataFrame, rows: Column) -> DataFrame:
    return docs.where(rows).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the dimension)) + 1 over all of ``texts.text`` with letters. Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, n = Grams(), np.zeros(DIMENSIONS, np.int64), 0
        for b in batches:
            for text in b.column(0):
                if (c := grams.counts(text.as_py())) is not None:
                    seen += c > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], names=["at", "n"])

    found = texts.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # DIMENSIONS + 1 rows at most
    n = dict(zip(found["at"].tolist(), found["n"].tolist(), strict=True))
    seen = np.array([n.get(k, 0) for k in range(DIMENSIONS)], np.float64)
    return (np.log((1 + n.get(-1, 0)) / (1 + seen)) + 1).astype(np.float32)


def cluster(vectors: np.ndarray, wanted: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii) by spherical k-means from far-apart texts on; a radius is a cosine distance that holds WITHIN of the texts."""
    mean = vectors.mean(0)
    chosen = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(wanted, len(vectors)) and nearest.min() < 0.999:
        order = np.argsort(nearest, kind="stable")
        chosen.append(int(order[len(order) // 50]))  # not the very farthest, which may be mislabelled
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen].copy()
    for _ in range(turns):
        own = np.argmax(vectors @ centroids.T, 1)
        sums = np.stack([vectors[own == k].sum(0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        moved = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    near, own = (vectors @ centroids.T).max(1), np.argmax(vectors @ centroids.T, 1)
    return centroids, np.array([np.quantile(1 - near[own == k], WITHIN) if (own == k).any() else 0.0 for k in range(len(centroids))])


class Model:
    """Centroids with their languages and radii, and the weights of dimensions."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, radii: np.ndarray):
        self.idf, self.langs, self.centroids, self.radii = idf, langs, centroids, radii
        self.names = sorted(set(langs))
        self.member = [np.array([k for k, x in enumerate(langs) if x == name]) for name in self.names]

    def predict(self, grams: Grams, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); the score is the language's share of the exponentials of all languages' similarities."""
        v = grams.vector(text, self.idf) if self.names else None
        if v is None:
            return UNKNOWN, 0.0, False
        near = self.centroids @ v
        best = np.array([near[m].max() for m in self.member], np.float64)
        k = int(np.argmax(best))
        share = np.exp((best - best[k]) / SHARPNESS)
        at = self.member[k][int(np.argmax(near[self.member[k]]))]
        return self.names[k], float(1 / share.sum()), bool(1 - near[at] <= self.radii[at])


def fit(docs: DataFrame, rows: Column, languages: int = LANGUAGES, texts: int = TEXTS, centroids: int = CENTROIDS) -> Model:
    """Learns from the ``rows`` of ``docs`` with language and text.

    Weights go by all of them. Centroids go by about ``texts`` of each of the ``languages`` most frequent languages, those
    with small hashes of id and text; every language is clustered in a task of its own, which no language can outgrow.
    """
    known = _learnable(docs, rows)
    idf = inverse_frequencies(known)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.broadcast(counts.select("lang", (F.lit(float(texts)) / F.col("n")).alias("share")))  # ``languages`` rows at most
    place = (F.xxhash64("doc_id", "text").cast("double") + 2.0**63) / 2.0**64
    sample = known.join(share, "lang").where(place < F.col("share")).select("lang", place.alias("place"), "text").dropDuplicates(["lang", "place"])  # a row repeated at will counts once

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                rows = [None if v is None else v.tobytes() for v in (grams.vector(x.as_py(), idf) for x in part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["lang", "place", "vector"])

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        some = np.stack([np.frombuffer(x, np.float32) for x in rows["vector"]])
        middles, radii = cluster(some, centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "k": range(len(radii)), "centroid": [c.astype(np.float32).tobytes() for c in middles], "radius": radii})

    learnt = sample.mapInArrow(vectors, "lang string, place double, vector binary").where("vector is not null")
    found = learnt.groupBy("lang").applyInPandas(clustered, "lang string, k int, centroid binary, radius double").toPandas().sort_values(["lang", "k"])  # languages * centroids rows at most
    stacked = np.stack([np.frombuffer(c, np.float32) for c in found["centroid"]]) if len(found) else np.empty((0, DIMENSIONS), np.float32)
    return Model(idf, found["lang"].tolist(), stacked, found["radius"].to_numpy(np.float64))


def identify(docs: DataFrame, folds: int = 5, held: int = 0, texts: int = TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each row of ``docs``; held-out ids are never learnt from.

    Only the text enters a prediction. Null texts, texts without letters, and all texts if there was nothing to learn from
    are ``und`` with score 0. ``accepted`` tells whether the text lies within the radius of its nearest centroid; callers
    that want rejection take ``und`` elsewhere. A null id counts as the empty text when folds are dealt, ties go to the
    first language by name, repeated rows score alike, empty tables give no rows, other columns are ignored.
    """
    model = fit(docs, remainder("doc_id", folds) != held, texts=texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            got = [model.predict(grams, x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder("doc_id", folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
