"""Spelling variants: words one edit apart, found through an index of grams of variable length.

A frequency-pruned dictionary holds the frequent grams. A word is decomposed into variable grams: from every position the
shortest gram that isn't frequent, or the longest allowed one; grams that lie inside an earlier one are left out. One edit
at a position can only change grams whose end lies in the ``q_max`` positions after it, so a word's bound of affected grams
is the largest number of gram ends in such a stretch. Two words one edit apart share all other grams, hence one of the rarest
bound + 1 grams of either; everything before it or everything after it is equal too. Those stretches are the index keys.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch

Q_MIN = 2
#: The frequent grams of one length and band are at most so many.
DICTIONARY = 20_000
#: A gram with more occurrences is frequent, where DICTIONARY allows.
FREQUENT = 64
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A worker counts words together until it has seen so many different ones.
HELD_WORDS = 200_000


def words_of(doc: str, text: str, run_pattern: re.Pattern, least_length: int, modulus: int) -> Iterator[str]:
    """The text's words; where the modulus divides a run's checksum with its document, the run loses one letter."""
    start = crc32(f"{doc}:".encode())
    for run in run_pattern.findall(text):
        run = run.lower() if run.isascii() else run.translate(_LOWER)
        h = crc32(run.encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least_length:
            yield run


def word_counts(docs: DataFrame, least_length: int, least_n: int, modulus: int) -> DataFrame:
    """(word, n) of the runs of letters with the given length and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), Counter()
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                held.update(words_of(doc.as_py(), text.as_py(), pattern, least_length, modulus))
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def bands(least_length: int, longest: int = 6) -> list[tuple[int, int]]:
    """(shortest length, longest gram) by rising length. A word of at least twice the longest gram keeps one gram whatever the edit."""
    if least_length < 2 * (Q_MIN + 1):
        raise ValueError(f"words must have at least {2 * (Q_MIN + 1)} letters")
    first = least_length // 2
    return [(least_length, min(first, longest))] + [(2 * q, q) for q in range(first + 1, longest + 1) if q % 2 == 0 and 2 * q > least_length]


def bands_of(length: int, all_bands: list[tuple[int, int]]) -> list[int]:
    """The bands of a word: its own, where it may be the shorter of a pair, and that of words one letter shorter."""
    own = max(k for k, (low, _) in enumerate(all_bands) if low <= length)
    return [own, own - 1] if own and all_bands[own][0] == length else [own]


def decompose(word: str, frequent: dict[str, int], q_max: int) -> list[tuple[int, int]]:
    """(start, end) of the word's variable grams; both rise strictly."""
    grams, reach, n = [], 0, len(word)
    for p in range(n - Q_MIN + 1):
        e = p + Q_MIN
        while e < n and e - p < q_max and word[p:e] in frequent:
            e += 1
        if e > reach:
            grams.append((p, e))
            reach = e
    return grams


def most_affected(grams: list[tuple[int, int]], q_max: int) -> int:
    """How many of the grams one edit changes at most."""
    most = low = 0
    for k, (_, e) in enumerate(grams):
        while grams[low][1] <= e - q_max:
            low += 1
        most = max(most, k - low + 1)
    return most


def index_keys(word: str, frequent: dict[str, int], q_max: int) -> set[str]:
    """The stretches from the start or up to the end of the word that its rarest bound + 1 grams close or open.

    A stretch that holds a gram counted at most FREQUENT times has no longer list, and is a key as it is. Else the key is
    the stretch with the remainder, or with the remainder less one letter, so that its list has at most alphabet times
    length words. Which of the two holds goes by the stretch alone, the same for all words.
    """
    grams = decompose(word, frequent, q_max)
    order = sorted(grams, key=lambda g: (frequent.get(word[g[0] : g[1]], 0), word[g[0] : g[1]], g[0]))
    parts = set()
    for p, e in order[: most_affected(grams, q_max) + 1]:
        parts |= {("<", word[:e], word[e:]), (">", word[p:], word[:p])}
    keys = set()
    for side, stretch, rest in parts:
        if min(frequent.get(stretch[k : k + q_max], frequent[""]) for k in range(max(1, len(stretch) - q_max + 1))) <= FREQUENT:
            keys.add(side + stretch)
        else:
            keys.add(f"{side}{stretch}|{rest}")
            keys |= {f"{side}{stretch}|{rest[:k]}{rest[k + 1:]}" for k in range(len(rest))}
    return keys


def frequent_grams(words: DataFrame, all_bands: list[tuple[int, int]]) -> list[dict[str, int]]:
    """For each band its frequent grams with their counts, and the most that any other gram has as the count of ''.

    By their counts there are at most DICTIONARY of each length, so they fit any driver.
    """
    found = []
    for k, (low, q_max) in enumerate(all_bands):
        high = all_bands[k + 1][0] if k + 1 < len(all_bands) else None
        in_band = words.where(F.length("word") >= low)
        if high:
            in_band = in_band.where(F.length("word") <= high)
        sizes = F.array(*(F.lit(q) for q in range(Q_MIN, q_max + 1)))
        grams = in_band.select("word", F.explode(sizes).alias("q")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("q") + 1), lambda i: F.substring(F.col("word"), i, F.col("q")))).alias("gram"))
        counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
        places = in_band.agg(F.sum(F.length("word"))).first()[0] or 0  # no length has more occurrences, so none has more than DICTIONARY frequent grams
        least = max(FREQUENT, places // DICTIONARY)
        found.append({"": least} | {r.gram: r.n for r in counts.where(F.col("n") > least).toLocalIterator()})
    return found


def near_words(words: DataFrame, scratch: Scratch, least_length: int) -> DataFrame:
    """(a, b), a < b: all pairs of ``words.word`` that one inserted, deleted or replaced code point makes equal.

    No key's list is longer than FREQUENT words or alphabet times length.
    """
    all_bands = bands(least_length)
    dictionaries = frequent_grams(words, all_bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                key, word = [], []
                for w in whole.column(0).slice(start, 2000).to_pylist():
                    for k in bands_of(len(w), all_bands):
                        found = [f"{k}{x}" for x in index_keys(w, dictionaries[k], all_bands[k][1])]
                        key += found
                        word += [w] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word, pa.string())], names=["key", "word"])

    keys = words.select("word").mapInArrow(run, "key string, word string").select(F.xxhash64("key").alias("key"), "word")
    keys = scratch.table(keys, "keys")
    pairs = keys.withColumnRenamed("word", "a").join(keys.withColumnRenamed("word", "b"), "key").where("a < b and levenshtein(a, b, 1) = 1")
    return pairs.select("a", "b").distinct()


def roots(forms: DataFrame, most: int, factor: int, scratch: Scratch) -> DataFrame:
    """(word, root): the last word that ``forms(word, form)`` lead to. Each step multiplies the count by ``factor`` at least, so
    counts up to ``most`` bound the steps, and every round doubles those taken."""
    found, steps = forms.select("word", F.col("form").alias("root")), max(1, math.floor(math.log(max(most, 2), factor)) + 1)
    for turn in range(math.ceil(math.log2(steps))):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = scratch.table(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{turn}")
    return found


def group_spellings(docs: DataFrame, least_length: int = 7, least_n: int = 2, factor: int = 10, modulus: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts with its length and count.

    A word's form is its near word of the largest count, ties to the smallest, if that is ``factor`` times its own count or
    more. Null texts have no words, a null id counts as the empty text in the checksum, repeated rows count again, empty
    tables give no rows, other columns are ignored. Order of words is that of code points.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.table(word_counts(docs, least_length, least_n, modulus), "words")
    pairs = scratch.table(near_words(words, scratch, least_length), "pairs")
    scratch.free("words", "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = words.join(best, "word", "left").withColumn("takes", -F.col("best.less") >= factor * F.col("n"))
    judged = scratch.table(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.expr("if(takes, best.other, null)").alias("form"), F.expr("if(takes, -best.less, null)").cast("bigint").alias("form_n")), "judged")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(judged.where("form is not null").select("word", "form"), most, factor, scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
