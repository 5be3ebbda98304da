"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the BPE encoding of its text exactly if each piece encodes to itself and each two neighbours are
what merging their joined text gives. The encoder walks the text with the longest Aho-Corasick match at each place, tests
the new piece against its left neighbour by merging the two again, falls back to shorter matches, and keeps a bitfield of
places from which no way leads to the end.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_texts

SPACE = "▁"
#: Bytes of chunks, with their results, and of pairs of neighbours that a worker's younger generation holds; the older one holds
#: as much. Chunks are forgotten with each partition.
CHUNK_BYTES, PAIR_BYTES = 80 << 20, 24 << 20
#: What Python takes for an entry of each kind besides its text.
CHUNK_ENTRY, PAIR_ENTRY = 360, 110


class Recent(dict):
    """The entries added or looked for again of late: once they exceed ``most`` bytes they become the older generation, and what
    that held is forgotten. ``get`` finds young entries only, ``recall`` takes an old one over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size, self.old = most, 0, {}

    def add(self, key, value, size: int):
        if self.size + size > self.most:
            self.old = self.copy()
            super().clear()
            self.size = 0
        self[key] = value
        self.size += size
        return value

    def recall(self, key, size: int):
        value = self.old.get(key)
        return None if value is None else self.add(key, value, size)

    def clear(self) -> None:
        super().clear()
        self.size, self.old = 0, {}


class PieceCodec:
    """A vocabulary of the merge type, read from a SentencePiece model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.end = model.eos_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.known = {c for p in self.ids for c in p}
        if not self.known <= self.ids.keys():
            raise ValueError("the vocabulary lacks characters of its pieces")
        #: Merges never cross a place between two characters that no piece holds side by side.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            # pieces that merging never makes can't stand in an encoding
            if len(p) == 1 or self.merge(p) == [p]:
                self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.fits = Recent(PAIR_BYTES)  # by left << 20 | right
        self.seen = Recent(CHUNK_BYTES)
        # no piece has a space mark after another character, so merges never cross the place before such a mark
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces over more than one word")
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if "\n" not in self.known else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

        # what is assumed of the model's normalizer, prefix, byte fallback and decoder
        for text in ("a  b", " a ", "", "\u00a0x\u3000", "\ufb01 \uff21", "e\u0301 \t\n\r", "\U0001f600\x00", SPACE, "  "):
            ids = model.encode(text)
            if self.encode(text) != ids or self.decode(ids) != model.decode(ids):
                raise ValueError(f"the model treats {text!r} otherwise than this encoder")

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives: always the best-scored neighbours first, of equals the leftmost."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, both, j))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        return [p for p in parts if p is not None]

    def fit(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            got = self.fits.recall(key, PAIR_ENTRY)
        if got is None:
            pa_, pb = self.pieces[a], self.pieces[b]
            got = self.fits.add(key, self.merge(pa_ + pb) == [pa_, pb], PAIR_ENTRY)
        return got

    def walk(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, found in self.matches.iter(text):
            at[last + 1 - found[0]].append(found)  # ends rise, so the longest comes last
        fits, fit = self.fits.get, self.fit
        dead = bytearray(n + 1)
        ids: list[int] = []
        back: list[tuple[int, int]] = []  # place, next option to try there
        pos, option = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while option >= 0:
                size, i = options[option]
                if not dead[pos + size]:
                    if not ids:
                        break
                    ok = fits(ids[-1] << 20 | i)
                    if ok or (ok is None and fit(ids[-1], i)):
                        break
                option -= 1
            if option >= 0:
                back.append((pos, option))
                ids.append(i)
                pos += size
                option = len(at[pos]) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                pos, option = back.pop()
                ids.pop()
                option -= 1
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of any chunk; unknown characters never merge and become bytes."""
        known = self.known
        if known.issuperset(chunk):
            return self.walk(chunk)
        out: list[int] = []
        start = 0
        for k, c in enumerate(chunk):
            if c not in known:
                if k > start:
                    out += self.walk(chunk[start:k])
                out += [self.byte[b] for b in c.encode()]
                start = k + 1
        return out + (self.walk(chunk[start:]) if start < len(chunk) else [])

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids, with space marks."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without end id."""
        if not text:
            return []
        return [i for c in self.chunk.findall(SPACE + text.replace(" ", SPACE)) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_part(ids).removeprefix(SPACE).replace(SPACE, " ")

    def _encoded(self, chunk: str) -> tuple[str, str]:
        ids = self.encode_chunk(chunk)
        decoded = self.decode_part(ids)
        return self._keep(chunk, (" ".join(map(str, ids)), chunk if decoded == chunk else decoded))

    def _keep(self, chunk: str, got: tuple[str, str]) -> tuple[str, str]:
        if len(chunk) <= 48:
            self.seen.add(chunk, got, CHUNK_ENTRY + 2 * len(chunk) + len(got[0]))
        return got

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids and decoded text of a chunk, remembered; a last character that can't merge is encoded alone."""
        if (got := self.seen.get(chunk)) or (chunk in self.seen.old and (got := self._keep(chunk, self.seen.old[chunk]))):
            return got
        if len(chunk) < 2 or chunk[-2:] in self.pairs:
            return self._encoded(chunk)
        a, b = self._chunk(chunk[:-1]), self._chunk(chunk[-1])
        return self._keep(chunk, (f"{a[0]} {b[0]}", a[1] + b[1]))

    def forget(self) -> None:
        """What is known of pairs stays, within its bytes: it is about the vocabulary, not about texts. Their keys are made anew
        once the chunks are gone: made between the chunks, they would hold the worker's memory around them."""
        size, generations = self.fits.size, [np.array([list(g), [*g.values()]], np.int64) for g in (self.fits, self.fits.old)]
        self.seen.clear()
        self.fits.clear()
        young, self.fits.old = (dict(zip(keys.tolist(), map(bool, oks), strict=True)) for keys, oks in generations)
        self.fits.update(young)
        self.fits.size = size

    def round_trip(self, text: str | None) -> tuple[str, str]:
        """(ids with the end id, in decimal and joined by spaces; the text decoded from them).

        Chunks are encoded and decoded alone: merges don't cross them and bytes of a character never part.
        """
        if not text:
            return str(self.end), ""
        get, make = self.seen.get, self._chunk
        parts = [get(c) or make(c) for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))]
        return f"{' '.join([p[0] for p in parts])} {self.end}", "".join([p[1] for p in parts]).removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids with ``keep_ids``) of each whole text.

    One row per row of ``docs``, without a shuffle; each worker reads the model file at ``model_path`` once. Null and empty
    texts give the end id alone and an empty decoded text; null ids stay null; an empty table gives no rows; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                line, decoded = c.round_trip(text)
                n.append(line.count(" ") + 1)
                ids_sha.append(_sha(line))
                text_sha.append(_sha(decoded))
                if keep_ids:
                    ids.append([int(x) for x in line.split(" ")])
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, names=names + ["token_ids"] * keep_ids)
        c.forget()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)
