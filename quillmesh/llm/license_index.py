"""Licence scans through a positional index of rare words.

Licence texts are indexed by word and position. A file's licence words with high inverse document frequency look up their
postings; postings that agree on where the text would start, give or take a few words, propose it there. It counts if its
key phrases stand in that span and enough of its words lie there in order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.license_texts import TEMPLATES

#: Phrase and label of the base rules.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: A text counts if this share of its words lies there in order.
MATCHED = 0.6
#: Words by which an inserted or missing passage may shift what follows, at most; a quarter of a short text.
SLACK = 6
#: Labels whose whole text stands in another label's; the longer one alone is named.
WITHIN = {"bsd-2": ("bsd-3",)}
#: Words of a template that files look up, besides those of its key phrases.
RARE = 6
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def slack(size: int) -> int:
    return max(1, min(SLACK, size // 4))


class LicenseIndex:
    """Postings (template, position) of the words that files look up, and the key phrases.

    A template is looked up by its RARE highest-IDF words, ties included, and the two rarest words of each key phrase: a file
    without those can't hold the phrase.
    """

    def __init__(self, templates: list[tuple[str, str, list[str]]], df: dict[bytes, int], n_docs: int):
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1]) for t in templates]
        self.keys = [[words_of(k) for k in t[2]] for t in templates]
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            order = sorted({self.idf[w] for w in ws}, reverse=True)
            least = order[min(len(order), RARE) - 1]
            rare = {w for w in ws if self.idf[w] >= least}
            for key in self.keys[t]:
                rare |= set(sorted(set(key), key=lambda w: (-self.idf.get(w, 0), w))[:2])
            for p, w in enumerate(ws):
                if w in rare:
                    self.postings[w].append((t, p))
        self.rare = frozenset(self.postings)
        #: Where each key phrase stands in its template.
        self.key_at = [[[p for p in range(len(ws)) if ws[p : p + len(k)] == k] for k in keys] for ws, keys in zip(self.words, self.keys, strict=True)]
        if not all(at for keys in self.key_at for at in keys):
            raise ValueError("a key phrase does not stand in its text")
        # bit p of a template's mask for w: word p is w
        self.masks: list[dict[bytes, int]] = []
        for ws in self.words:
            self.masks.append(masks := defaultdict(int))
            for p, w in enumerate(ws):
                masks[w] |= 1 << p

    def in_order(self, t: int, span: list[bytes]) -> float:
        """Share of the template's words that the span holds in order: their longest common subsequence, bit by bit."""
        size, masks = len(self.words[t]), self.masks[t]
        rows = (1 << size) - 1
        for w in span:
            if m := masks.get(w):
                met = rows & m
                rows = (rows + met) | (rows - met)
                rows &= (1 << size) - 1
        return (size - rows.bit_count()) / size

    def verify(self, t: int, words: list[bytes], low: int, high: int) -> float:
        """The template's largest share in order over starts a shift from ``low`` to ``high`` at most, at which every key phrase
        stands, shifted no further either; 0 if there is none."""
        size = len(self.words[t])
        shift = slack(size)
        starts = set(range(low - shift, high + shift + 1))
        for key, offsets in zip(self.keys[t], self.key_at[t], strict=True):
            first, last = max(0, low - 2 * shift + offsets[0]), high + 2 * shift + offsets[-1] + 1
            here = [q for q in range(first, min(last, len(words))) if words[q : q + len(key)] == key]
            starts &= {s for q in here for p in offsets for s in range(q - p - shift, q - p + shift + 1)}
        return max((self.in_order(t, words[max(0, s - shift) : max(0, s + size + shift)]) for s in starts), default=0.0)

    def match(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """Label and share of the texts that a file holds. The rarest words of the file are looked up first."""
        starts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        places: dict[bytes, list[int]] = defaultdict(list)
        for d, w in enumerate(words):
            if w in present:
                places[w].append(d)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings[w]:
                starts[t] += [(d - p, w) for d in places[w]]
        found: dict[str, float] = {}
        for t, at in starts.items():
            at.sort()
            first = 0
            for k in range(1, len(at) + 1):
                # a run of starts, each no further from the one before than a shift
                if k < len(at) and at[k][0] - at[k - 1][0] <= slack(len(self.words[t])):
                    continue
                if len({w for _, w in at[first:k]}) >= min(2, len(set(self.words[t]))) and (share := self.verify(t, words, at[first][0], at[k - 1][0])) >= MATCHED:
                    found[self.labels[t]] = max(found.get(self.labels[t], 0.0), share)
                first = k
        return {k: v for k, v in found.items() if not any(found.get(other, 0.0) >= v for other in WITHIN.get(k, ()))}


def _base(words: list[bytes], joined: bytes) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    for phrase, label in PHRASES:
        raw = phrase.encode()
        if b" " + raw + b" " not in joined:
            continue
        parts = raw.split()
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                places.append(at)
                labels.add(label)
    return places, labels


def document_frequencies(texts: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many rows each vocabulary word stands, and how many rows there are; the vocabulary bounds what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[b""] += 1
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``.

    Base places are where a phrase's words stand consecutively; their labels always stay. ``score`` is 1 with a base label,
    else the largest share of a licence text's words that lie in place and order, 0 without labels. Null and empty texts have no words
    and no labels (empty strings); null ids stay null; repeated rows are scanned alike; an empty table gives no rows; other
    columns are ignored. Document frequencies cover all rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = frozenset(w for t in templates for w in words_of(t[1]))
    index = LicenseIndex(templates, *document_frequencies(rows.select("text"), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                present = index.rare.intersection(words)
                places: list[int] = []
                base: set[str] = set()
                found: dict[str, float] = {}
                if words:
                    joined = b" " + b" ".join(words) + b" "
                    places, base = _base(words, joined)
                    if len(present) > 1:
                        found = index.match(words, present)
                score = 1.0 if base else max(found.values(), default=0.0)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
