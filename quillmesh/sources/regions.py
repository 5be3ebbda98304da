"""Nesting regions of source text: bracket pairs over tokens, with comments and texts masked.

A file becomes one row with an array of tokens. A bracket's ``mate`` is the token that closes or opens it, a token's ``region``
the innermost bracket around it, both by prefix sums over the brackets of a whole batch. Facts are then read off inside the
row's array, so that neither contents nor tokens are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

TOKEN = "text string, line int, at int, mate int, region int"
#: A quoted text's token; its content is no code.
TEXT = "''"
#: Contents that are read together, in characters.
_TOGETHER = 1 << 20
# Comments and type arguments of calls are no tokens; a quote without its like on the line is one by itself.
_SCAN = re.compile(
    r"""(?P<skip>//[^\n\0]*|/\*(?:[^*\0]|\*(?!/))*(?:\*/)?|(?<=[\w$])<[^<>()=;\0]*(?:<[^<>()=;\0]*>[^<>()=;\0]*)?>(?=\())"""
    r"""|(?P<text>"(?:\\.|[^"\\\n\0])*"|'(?:\\.|[^'\\\n\0])*'|`(?:\\[^\0]|\$\{[^{}`\0]*\}|[^`\\\0])*`|(?<=[(,=:!&|?;\[])[ \t]*/(?![/*])(?:\\[^\n\0]|\[(?:\\[^\n\0]|[^\]\\\n\0])*\]|[^/\\\[\n\0])+/[a-z]*)"""
    r"""|(?P<code>[\w$]+|=>|\.\.\.|[!=]==?|&&|\|\||\?\.|\?\?|[^\s\0])"""
)


def nesting(kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mate, region) of each token, -1 for none: ``kinds`` are 1 for opening brackets, -1 for closing ones, else 0; files
    begin at ``starts``. Brackets pair off by depth, whatever their shape; one without a partner has none."""
    n = len(kinds)
    file = np.searchsorted(starts, np.arange(n), side="right") - 1
    after = np.cumsum(kinds)
    base = np.concatenate([[0], after])[starts]
    depth = after - base[file] - np.where(kinds == 1, 1, 0)  # around each token: brackets belong to what is outside them
    level = depth - depth.min(initial=0)
    brackets = np.flatnonzero(kinds)
    place = (file[brackets] * (level.max(initial=0) + 2) + level[brackets]) * (n + 1) + brackets
    order = brackets[np.argsort(place, kind="stable")]
    key = (file * (level.max(initial=0) + 2) + level)[order]
    pair = np.flatnonzero((kinds[order[:-1]] == 1) & (kinds[order[1:]] == -1) & (key[:-1] == key[1:]))
    mate = np.full(n, -1, np.int64)
    mate[order[pair]], mate[order[pair + 1]] = order[pair + 1], order[pair]
    # the last opening bracket one level further out, if it is still open
    opening = np.flatnonzero(kinds == 1)
    width = np.int64(level.max(initial=0) + 3)
    spots = np.sort((file[opening] * width + level[opening]) * (n + 1) + opening)
    wanted = (file * width + level - 1) * (n + 1) + np.arange(n)
    at = np.searchsorted(spots, wanted) - 1
    found = spots[np.maximum(at, 0)] if len(spots) else np.zeros(n, np.int64)
    same = (at >= 0) & (found // (n + 1) == wanted // (n + 1)) if len(spots) else np.zeros(n, bool)
    region = np.where(same, found % (n + 1), -1)
    return mate, region


def _tokens(contents: list[str]) -> pa.ListArray:
    joined = "\0".join(c.replace("\0", " ") for c in contents) + "\0"
    ends = np.cumsum([len(c) + 1 for c in contents])
    texts, begins = [], []
    for m in _SCAN.finditer(joined):
        if m.lastgroup != "skip":
            texts.append(m[0] if m.lastgroup == "code" else TEXT)
            begins.append(m.start())
    begin = np.array(begins, np.int64)
    starts = np.searchsorted(begin, np.concatenate([[0], ends[:-1]]))
    kind_of = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
    mate, region = nesting(np.array([kind_of.get(t, 0) for t in texts], np.int64), starts)
    breaks = np.array([m.start() for m in re.finditer("\n", joined)], np.int64)
    file = np.searchsorted(starts, np.arange(len(begin)), side="right") - 1
    first_break = np.searchsorted(breaks, np.concatenate([[0], ends[:-1]]))
    line = np.searchsorted(breaks, begin) - first_break[file] + 1
    base = starts[file]
    own = lambda x: np.where(x >= 0, x - base, -1).astype(np.int32)
    fields = [pa.array(texts, pa.string()), pa.array(line.astype(np.int32)), pa.array((np.arange(len(begin)) - base).astype(np.int32)), pa.array(own(mate)), pa.array(own(region))]
    rows = pa.StructArray.from_arrays(fields, names=["text", "line", "at", "mate", "region"])
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(begin)).astype(np.int32)), rows)


def read_once(files: DataFrame, *keep: str) -> DataFrame:
    """(content, files, tokens): what each content is read off to, and the ``files(path, keep...)`` that have it.

    Files of one content that arrive in one batch are read once; a content may come again in another batch. A null content is
    empty and has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(0).dictionary_encode()
            contents, at = texts.dictionary.to_pylist(), texts.indices.to_numpy()
            order = pa.array(np.argsort(at, kind="stable"))
            rows = pa.StructArray.from_arrays([c.take(order) for c in b.columns[1:]], names=b.schema.names[1:])
            owners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(contents)))]).astype(np.int32)), rows)
            start, size = 0, 0
            for k, c in enumerate(contents):
                size += len(c)
                if size >= _TOGETHER or k + 1 == len(contents):
                    n = k + 1 - start
                    yield pa.RecordBatch.from_arrays([texts.dictionary.slice(start, n), owners.slice(start, n), _tokens(contents[start : k + 1])], names=["content", "files", "tokens"])
                    start, size = k + 1, 0

    rows = files.select(F.coalesce("content", F.lit("")).alias("content"), "path", *keep)
    content, *own = rows.schema.fields
    return rows.mapInArrow(run, StructType([content, StructField("files", ArrayType(StructType(own))), StructField("tokens", ArrayType(StructType.fromDDL(TOKEN)))]))


def by_file(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows about contents, with ``files``, as rows of each file: path, ``keep`` and the other columns."""
    rest = [c for c in rows.columns if c != "files"]
    return rows.select(F.explode("files").alias("_file"), *rest).select(*(F.col(f"_file.{c}").alias(c) for c in ("path", *keep)), *rest)


def tokenized(files: DataFrame, *keep: str) -> DataFrame:
    """(path, keep..., tokens) of each file; a null content has no tokens."""
    return by_file(read_once(files, *keep).select("files", "tokens"), *keep)


def region_table(files: DataFrame) -> DataFrame:
    """(path, region, parent, bracket, head, first, last, line, end_line): each bracket pair with the token before it."""
    rows = read_once(files).select("files", "tokens", F.explode(F.filter("tokens", lambda t: t["text"].isin("(", "[", "{") & (t["mate"] >= 0))).alias("t"))
    token = lambda at: F.get("tokens", at)
    return by_file(rows.select(
        "files", F.col("t.at").alias("region"), F.col("t.region").alias("parent"), F.col("t.text").alias("bracket"), token(F.col("t.at") - 1)["text"].alias("head"),
        F.col("t.at").alias("first"), F.col("t.mate").alias("last"), F.col("t.line").alias("line"), token(F.col("t.mate"))["line"].alias("end_line"),
    ))


def part(tokens: Column | str, first: Column, last: Column) -> Column:
    """The tokens from ``first`` to ``last``, both included; none if they are the wrong way round."""
    return F.slice(tokens, first + 1, F.greatest(last - first + 1, F.lit(0)))


def text_at(tokens: Column | str, at: Column) -> Column:
    """The token's text, empty beside the array."""
    return F.coalesce(F.when(at >= 0, F.get(tokens, at)["text"]), F.lit(""))


def matches(files: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """(path, ord, line, one column per group) of each match in the code of a file, in its order, without a shuffle.

    Comments are blank, and what begins inside a text is no match. A group without a part in the match is empty; null
    contents have no matches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern, re.ASCII | re.DOTALL)
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = content.as_py()
                if not wanted.search(text):
                    continue
                inside, parts, at = [], [], 0
                for m in _SCAN.finditer(text):
                    if m.lastgroup == "text":
                        inside.append((m.start(), m.end()))
                    elif m.lastgroup == "skip" and text[m.start()] == "/":
                        parts += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0])]
                        at = m.end()
                plain = "".join([*parts, text[at:]])
                breaks = np.array([m.start() for m in re.finditer("\n", plain)], np.int64)
                begins, ends = np.array([x for x, _ in inside], np.int64), np.array([x for _, x in inside], np.int64)
                n = 0
                for m in wanted.finditer(plain):
                    k = int(np.searchsorted(begins, m.start(), side="right")) - 1
                    if k >= 0 and begins[k] < m.start() < ends[k]:
                        continue
                    rows.append((path, n, int(np.searchsorted(breaks, m.start())) + 1, *(g or "" for g in m.groups()[: len(groups)])))
                    n += 1
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * len(groups)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "ord", "line", *groups])

    return files.select("path", "content").where("content is not null").mapInArrow(run, ", ".join(["path string, ord int, line int", *(f"{g} string" for g in groups)]))
