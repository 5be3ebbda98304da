"""Collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly in a second pass.

All runs of 1 to ``longest`` words are dealt by hash over partitions whose masses, the numbers of occurrences, are counted
first. Tasks send each partition the counts of a block of text, which are summaries without error. A partition merges them
into one summary whose capacity exceeds its mass divided by the threshold, so that no counter falls short by the threshold
and every frequent run survives. Survivors set bits of a filter of bounded size; the second pass counts the runs that the
filter lets through, by their words, so neither collisions nor survivors by chance reach the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch

#: Bytes of text that are counted together.
BLOCK = 4 << 20
#: A partition's summary has about as many counters at most, where no single run fills it.
COUNTERS = 1 << 20
LEAST_PARTS = 256
#: Bits of the filter at most, 32 MB. Beyond, more runs pass it by chance; the result stays the same.
FILTER_BITS = 1 << 28
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Capital ASCII letters become small, the ends of pieces line feeds, tabs blanks.
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Words of texts in one language: ``ids`` number them, 0 ends a piece; the first ``known`` were counted before."""

    def __init__(self, lang: str, words: list[bytes], known: int):
        table = _Numbered({b"\n": 0})
        self.lang, self.words, self.known = lang, words, known
        self.ids = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, table), np.uint64, len(table))
        self.hashes = (hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))[self.ids]

    def runs(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, starts, hashes) of the runs of k words that no piece's end interrupts and that end behind the known words."""
        h, whole = _mix(self.hashes), self.ids > 0
        for k in range(1, longest + 1):
            if k > 1:
                h = _mix(h[:-1] * _A + self.hashes[k - 1 :])
                whole = whole[:-1] & (self.ids[k - 1 :] > 0)
            starts = np.flatnonzero(whole)
            starts = starts[np.searchsorted(starts, self.known - k + 1) :]
            yield k, starts, h[starts]

    def exact(self, starts: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct runs of k words at ``starts``, told apart by the numbers of their words, and how often each is there."""
        key = np.zeros(len(starts), np.int64)
        width = max(1, int(self.ids.max()).bit_length()) if len(self.ids) else 1
        for j in range(k):
            if (j + 1) * width > 62:  # so many different words: number the runs so far anew
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key << width | self.ids[starts + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return [b" ".join(self.words[i : i + k]) for i in starts[first].tolist()], n


def blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Block]:
    """The texts of (lang, text) rows in blocks; a longer text is cut between words, and its parts know the words before them."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[Block]:
        for lang, texts in held.items():
            data, at, before = b"\n".join(texts).replace(b"\n", b" \n "), 0, []
            while at < len(data):
                end = data.find(b" ", at + 2 * BLOCK)
                end = len(data) if end < 0 else end
                words = before + [w for w in data[at:end].split(b" ") if w]
                yield Block(lang, words, len(before))
                before, at = words[len(words) - longest + 1 :] if len(words) >= longest else words, end

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            data = text.as_buffer().to_pybytes().translate(_TABLE)
            held.setdefault(lang.as_py(), []).append(data)
            size += len(data) + 64
            if size >= BLOCK:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


class Summary:
    """A Misra-Gries summary: no count is too high, and none too low by more than ``error``, below mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merges another summary, itself without error, once enough of them wait."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.keys)).astype(np.int64)  # sums below 2**53 are exact
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > cut
            self.keys, self.counts, self.error = self.keys[stay], self.counts[stay] - cut, self.error + cut

    def survivors(self, least: int) -> np.ndarray:
        self.settle()
        return self.keys[self.counts + self.error >= least]


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")


def _masses(longest: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, n = np.zeros(1 << bits, np.int64), {}
        for block in blocks(batches, longest):
            for k, starts, h in block.runs(longest):
                mass += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=len(mass))
                if k == 1:
                    n[block.lang] = n.get(block.lang, 0) + len(starts)
        parts = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(parts) + list(n), pa.string()), pa.array([*parts.tolist(), *[None] * len(n)], pa.int32()), pa.array([*mass[parts].tolist(), *n.values()], pa.int64())], names=["lang", "part", "mass"])

    return run


def _block_summaries(longest: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, longest):
            keys, counts = np.unique(np.concatenate([h for _, _, h in block.runs(longest)]), return_counts=True)
            parts = (keys >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(parts, prepend=-1))
            ends = [*at[1:].tolist(), len(keys)]
            ranges = list(zip(at.tolist(), ends, strict=True)) if len(keys) else []
            yield pa.RecordBatch.from_arrays([
                pa.array(parts[at], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in ranges], pa.binary()), pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in ranges], pa.binary()),
            ], names=["part", "keys", "counts"])

    return run


def _survivors(mass: dict[int, int], least: int, bits: int, inner: int) -> Callable:
    """The bits of a part's filter; the part's bits in front, the next ``inner`` bits of a hash are its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for b in batches:
            for part, keys, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if part not in held:
                    held[part] = Summary(mass[part] // least + 1)
                held[part].add(np.frombuffer(keys.as_buffer(), np.uint64).copy(), np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64))
        for part in list(held):
            places = (held.pop(part).survivors(least) << np.uint64(bits)) >> np.uint64(64 - inner)
            filled = np.zeros(1 << inner, np.uint8)
            filled[places.astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(filled).tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _passed(longest: int, filter_bits: int, held) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for block in blocks(batches, longest):
            for k, starts, h in block.runs(longest):
                place = (h >> np.uint64(64 - filter_bits)).astype(np.int64)
                starts = starts[(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0]
                phrases, n = block.exact(starts, k)
                for a in range(0, len(phrases), 20_000):
                    some = phrases[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([block.lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([k] * len(some), pa.int32()), pa.array(n[a : a + 20_000], pa.int64())], names=["lang", "phrase", "k", "f"])

    return run


def frequent_runs(docs: DataFrame, longest: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all runs of 1 to ``longest`` words with f >= ``least``, exactly, and (lang, n) with all words."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = math.ceil(math.log2(max(LEAST_PARTS, longest * size / 2 / least / COUNTERS)))  # a word and what parts it have two bytes
    masses = scratch.table(texts.mapInArrow(_masses(longest, bits), "lang string, part int, mass bigint").groupBy("lang", "part").agg(F.sum("mass").alias("mass")), "masses")
    mass = {r.part: r.mass for r in masses.where("part is not null").toLocalIterator()}
    inner = max(3, math.ceil(math.log2(max(8, min(2 * sum(mass.values()) / least, FILTER_BITS)))) - bits)
    summaries = texts.mapInArrow(_block_summaries(longest, bits), "part int, keys binary, counts binary").repartition(max(8, (1 << bits) // 4), "part")
    bitmap = np.zeros(1 << (bits + inner - 3), np.uint8)
    width = 1 << (inner - 3)
    for r in summaries.mapInArrow(_survivors(mass, least, bits, inner), "part int, bits binary").toLocalIterator():
        bitmap[r.part * width : (r.part + 1) * width] = np.frombuffer(r.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())  # FILTER_BITS at most
    runs = texts.mapInArrow(_passed(longest, bits + inner, held), "lang string, phrase string, k int, f bigint")
    runs = scratch.table(runs.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "runs")
    return runs, masses.where("lang is not null").select("lang", F.col("mass").alias("n"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words.

    A phrase's score is that of its worst cut into two parts, l and r times there, floor(1000000 * a * a / (l * r)). Phrases
    inside a longer frequent one with ``share`` percent of their count or more are left out. Null texts have no words, a
    null or absent language is ``und``, repeated rows count again, ties go by count, then by bytes; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    runs, total = frequent_runs(docs, longest, least, scratch)
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    phrases = runs.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("*", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    scored = cuts.join(runs.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(runs.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    scored = scored.withColumn("score", F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    scored = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inside = phrases.where("k > 2").select("lang", F.col("a").alias("longer"), "k", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inside = inside.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at")).select("lang", "longer", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * {wide('longer')} < {share} * {wide('a')}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "worst", rank.alias("rank")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n", F.col("worst.score").alias("score"))
