"""Per-document word, line and symbol statistics, computed over whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that models learn from; each is scale-free, so it means the same for short and long texts.
RATIOS = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "shout_share", "pipe_share", "stutter_share", "stop_share", "log_words"]


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return out


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    g = window_hashes(words, width)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, RATIOS) of one text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    body = raw.translate(None, SPACES)
    chars = len(body) if body.isascii() else len(body.decode("utf-8", "replace"))
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    again = repeated_words(words)
    some = max(n, 1)
    ratios = [
        chars / some,
        symbols / max(chars, 1),
        dups / max(len(lines), 1),
        again / some,
        (len(body) - len(body.translate(None, UPPER))) / max(chars, 1),
        (len(body) - len(body.translate(None, DIGITS))) / max(chars, 1),
        len(set(words)) / some,
        raw.count(b"!") / some,
        raw.count(b"|") / some,
        sum(map(bytes.__eq__, words, words[1:])) / some,
        raw.count(b".") / some,
        float(np.log1p(n)),
    ]
    return [n, chars, symbols, dups, again], ratios


def _batches(text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py()) for x in batch.column(text)]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            ratios = np.array([r[1] for r in rows], np.float64).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(counts[:, i]) for i in range(len(COUNTS))] + [pa.array(ratios[:, i]) for i in range(len(RATIOS))],
                names=names + COUNTS + RATIOS,
            )

    return run


def text_stats(df: DataFrame, *carry: str, text: str = "text") -> DataFrame:
    """``carry`` columns plus COUNTS (bigint) and RATIOS (double) of each row's whole ``text``.

    One output row per input row, no shuffle. Null texts count as empty: all zero. A ``text`` that is a carried string goes to
    the workers once.
    """
    head = df.select(*carry).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head] + [f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATIOS])
    once = text in carry and head[text].dataType.simpleString() == "string"
    rows = df.select(*carry) if once else df.select(*carry, F.col(text).cast("string").alias("_text"))
    return map_texts(rows, _batches(text if once else "_text", list(carry)), schema)
