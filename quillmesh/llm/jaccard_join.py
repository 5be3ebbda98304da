"""Jaccard join of word-shingle sets: a size-aware heavy-light join, and the components of its links.

Sets that may link share much of a short prefix under one global order of shingles. Small sets list the two-element subsets
of their prefix; large sets enter inverted lists of single prefix elements; the size between them is where listing subsets
starts to cost more than scanning lists. The order puts shingles of many sets last, so passages that many documents share
make no long lists. Each set carries a parity sketch: bits in which two sketches differ stand for elements that one set
lacks, so too many of them rule a pair out. Members of a list are compared with one pivot first, so that a group of near
copies costs a star. Pairs that this leaves in different components are compared afterwards, those of long lists chunk
against chunk inside tasks that return only pairs no bound rules out. No link is lost: every pair of a list is either in one
component already, ruled out by a bound, or verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch, map_texts
from quillmesh.llm.components import components

#: A shingle in the pools of this many sets goes to the end of the order. It steers cost, not results.
HEAVY = 16
#: A list of up to this many members is joined with itself; a longer one is compared in chunks of about this many.
LISTED, CHUNK = 32, 256
#: Sketch columns of 64 bits each.
SKETCH = [f"bits{k}" for k in range(4)]


class WordHashes(dict):
    """64-bit hashes of words, remembered while a partition is read: of ``most`` words of up to 64 bytes, about 10 MB."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` make one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.int64)
    h = np.array([hashes[w] for w in words], np.int64).view(np.uint64)
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit k tells whether an odd number of elements fall into bin k."""
    bins = 64 * len(SKETCH)
    odd = np.bincount((shingles >> 20) & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(df: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """id, key, n, sketch and the set: all of it, or its pool of smallest hashes, which holds a quarter more than the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(x, width, hashes) for x in part.column("text").to_pylist()]
                bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                n = [len(s) for s in sets]
                if not whole:
                    sets = [s[: (p := len(s) - -(-percent * len(s) // 100) + 1) + max(3, p // 4)] for s in sets]
                columns = [part.column("id"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), *(pa.array(b) for b in bits.T), _lists(sets)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "n", *SKETCH, "pool"])

    return map_texts(df, run, f"id bigint, key binary, n bigint, {' bigint, '.join(SKETCH)} bigint, pool array<bigint>")


def _linked(df: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of whole texts whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, keep = whole.slice(at, 200), []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    u, v = shingle_set(x, width, hashes), shingle_set(y, width, hashes)
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(100 * both >= percent * (len(u) + len(v) - both) > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_texts(df.select("a", "b", "x", "y"), run, "a bigint, b bigint")


#: A side of up to this many short rows is broadcast after counting it; a larger one is shuffled.
SMALL_SIDE = 400_000


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else df


def _prefixes(sets: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """id, n, p, pre (p + 1 elements or more, heavy ones last), light (how many of them are not heavy), full (whether the pool reaches so far)."""
    bad = sets.select("id", F.explode("pool").alias("s")).join(heavy, "s").groupBy("id").agg(F.collect_set("s").alias("bad"))
    pool = F.when(F.col("bad").isNull(), F.col("pool")).otherwise(F.concat(F.array_except("pool", "bad"), F.array_sort("bad")))
    light = F.size("pool") - F.coalesce(F.size("bad"), F.lit(0))
    p = F.expr(f"cast(n - cast(ceil({percent} * n / 100.0d) as bigint) + 1 as int)")
    out = sets.join(bad, "id", "left").select("id", "n", *SKETCH, p.alias("p"), pool.alias("pool"), light.alias("light"))
    # what stands first in the order is known to here
    known = F.expr("greatest(p + 1, if(size(pool) = n, 2 * p + 8, least(light, 2 * p)))").alias("known")
    out = out.select("id", "n", *SKETCH, "p", "pool", "light", known, F.expr("light > p or size(pool) = n").alias("full"))
    return out.select("id", "n", *SKETCH, "p", F.expr("slice(pool, 1, known)").alias("pre"), F.expr("least(light, known, size(pool))").alias("light"), "full")


def _possible(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared) of the written ``pairs`` that sizes and prefixes don't rule out.

    Up to where the first of two prefixes ends, both are known whole: what one has there and the other lacks is missing from
    the other set. Rare shingles stand first, so the edits that part two copies of one text are among them.
    """
    ids = _sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    cut = cut.join(ids, "id", "left_semi")
    side = lambda id_, x: cut.select(F.col("id").alias(id_), F.expr(f"struct(n, light, pre as e, size(pre) > light as late, element_at(pre, -1) as last) as {x}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = both.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    x_first = "(x.late = y.late and x.last <= y.last) or (y.late and not x.late)"
    both = both.select("a", "b", "x", "y", F.size(F.array_intersect("x.e", "y.e")).alias("shared"), F.expr(f"ceil({percent} * (x.n + y.n) / {100 + percent}.0d)").alias("need"), F.expr(f"if({x_first}, struct(x.late, x.last), struct(y.late, y.last))").alias("end"))
    upto = lambda x: f"if(end.late, {x}.light + size(filter({x}.e, (q, i) -> i >= {x}.light and q <= end.last)), size(filter({x}.e, (q, i) -> i < {x}.light and q <= end.last)))"
    return both.where(f"x.n - ({upto('x')} - shared) >= need and y.n - ({upto('y')} - shared) >= need").select("a", "b", "shared")


def _fits(percent: int) -> str:
    """SQL: whether (n, i, sketch) and (m, j, sketch2) may link, by sizes, by the places i and j of a shared shingle, before
    which at most min(i, j) are shared, and by sketch bits that differ."""
    need = f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"
    bits = " + ".join(f"bit_count({c} ^ {c}2)" for c in SKETCH)
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and 1 + least(i, j) + least(n - i - 1, m - j - 1) >= {need} and {bits} <= n + m - 2 * {need}"


#: A member of a list, as a chunk holds it, and how many elements of its prefix before the shared one go with it.
MEMBER, BEFORE = ["id", "component", "n", "i", *SKETCH], 8


def _with_before(mixed: DataFrame, long: DataFrame, cut: DataFrame) -> DataFrame:
    """The members in lists of ``long(sig, size)``, with ``before``, the last elements of their prefix before the list's, and
    ``least``: so many common ones there mean that an earlier list has both members as well. That is one element, or two in
    lists of two-element subsets, whose first element is among them. Ids with several sets have none."""
    rows = mixed.join(long.select("sig"), "sig")
    one = cut.join(rows.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("sets"), F.min("pre").alias("pre")).where("sets = 1").select("id", "pre")
    before = F.expr(f"if(pre is null, cast(array() as array<bigint>), slice(pre, greatest(1, i - {BEFORE - 1}), least(i, {BEFORE})))").alias("before")
    least = F.when(F.xxhash64(F.lit(1), F.expr("get(pre, i)")) == F.col("sig"), 1).otherwise(2).alias("least")
    return rows.join(one, "id", "left").select("sig", *MEMBER, before, least)


def _chunks(mixed: DataFrame, long: DataFrame) -> DataFrame:
    """(x, y): each two chunks of a list in ``long(sig, size)`` whose members may lie in different components.

    A component of a quarter of a chunk or more has chunks of its own, which don't meet each other; smaller ones share chunks.
    A list's left chunks are dealt in sixteens, and its right ones repeated for each sixteen, so that no task has all pairs.
    """
    held = mixed.join(long, "sig")
    parts = held.groupBy("sig", "component").agg(F.count("*").alias("k"))
    own = f"4 * k > {CHUNK}"
    piece = f"if({own}, struct(component as block, 1 + pmod(xxhash64(id), (k + {CHUNK - 1}) div {CHUNK}) as piece), struct(pmod(xxhash64(component), (size + {CHUNK - 1}) div {CHUNK}) as block, 0L as piece))"
    member = F.struct(*(c for c in mixed.columns if c != "sig")).alias("x")
    rows = held.join(parts, ["sig", "component"]).select("sig", F.expr(piece).alias("chunk"), member, (F.floor(F.col("size") / (16 * CHUNK)) + 1).alias("deals"))
    rows = rows.groupBy("sig", "chunk", "deals").agg(F.collect_list("x").alias("x"))
    left = rows.withColumn("deal", F.expr("pmod(xxhash64(chunk), deals)")).drop("deals")
    right = rows.select("sig", F.col("chunk").alias("chunk2"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal"))
    return left.join(right, ["sig", "deal"]).where("chunk <= chunk2 and not (chunk.piece > 0 and chunk2.piece > 0 and chunk.block = chunk2.block)").select("x", "y")


def _padded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A row of BEFORE places for each list, and which of them are filled."""
    filled = np.arange(BEFORE) < column.value_lengths().to_numpy(zero_copy_only=False)[:, None]
    out = np.zeros(filled.shape, np.int64)
    out[filled] = column.flatten().to_numpy()
    return out, filled


def _chunk_pairs(mixed: DataFrame, long: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b): pairs of different components in the lists of ``long(sig, size)`` that no bound rules out, at least once each.

    With ``nearest`` a member is only paired with the nearest member, by sketch, of each other component in a chunk. Where
    ``mixed`` has ``before`` and ``least``, near copies, which share most of their prefixes, leave the first list that has both
    and not each one.
    """
    both, known = _chunks(mixed, long), "before" in mixed.columns

    def columns(cell: pa.StructArray) -> dict[str, np.ndarray]:
        got = {c: cell.field(c).to_numpy(zero_copy_only=False) for c in MEMBER + ["least"] * known}
        return got | ({"before": _padded(cell.field("before"))} if known else {})

    def later(x: dict, y: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs an earlier list has as well."""
        (u, uf), (v, vf), out = x["before"], y["before"], [np.empty(0, bool)]
        for k in range(0, len(a), 20_000):
            p, q = a[k : k + 20_000], b[k : k + 20_000]
            same = (u[p][:, :, None] == v[q][:, None, :]) & uf[p][:, :, None] & vf[q][:, None, :]
            out.append(same.sum((1, 2)) >= np.maximum(x["least"][p], y["least"][q]))
        return np.concatenate(out)

    def pairs(x: dict, y: dict, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        n, m, i, j = x["n"][rows, None], y["n"], x["i"][rows, None], y["i"]
        need = (percent * (n + m) + 99 + percent) // (100 + percent)
        bound = 1 + np.minimum(i, j) + np.minimum(n - i - 1, m - j - 1)
        # unsigned, as numpy counts the bits of a negative number's absolute value
        apart = sum(np.bitwise_count((x[c][rows, None] ^ y[c]).view(np.uint64)).astype(np.int64) for c in SKETCH)
        ok = (x["component"][rows, None] != y["component"]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (bound >= need) & (apart <= n + m - 2 * need)
        a, b = np.nonzero(ok)
        if nearest and len(a):
            order = np.lexsort((y["id"][b], apart[a, b], y["component"][b], a))
            a, b = a[order], b[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (y["component"][b[1:]] != y["component"][b[:-1]])
            a, b = a[first], b[first]
        a = a + rows.start
        if known and len(a):
            first = ~later(x, y, a, b)
            a, b = a[first], b[first]
        return x["id"][a], y["id"][b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = columns(batch.column("x")[k].values), columns(batch.column("y")[k].values)
                step = max(1, CHUNK * CHUNK // len(y["id"]))
                for at in range(0, len(x["id"]), step):
                    a, b = pairs(x, y, slice(at, at + step))
                    found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; links need ``percent`` % Jaccard similarity.

    Lower-cases A-Z; words are ``[^\\x20\\x09-\\x0D]+``. A text with fewer words than ``width`` is one shingle. Null and
    empty texts have empty sets and link with nothing. Equal sets always link; rows of one id are one document; a null id
    is no node: its row gets the component of its set, if others have it. Empty tables give no rows; other columns are
    ignored. Exact: the prefix filter loses no pair, every candidate is verified on whole sets.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    pools = scratch.table(_sets(source, width, percent, False), "pools")
    every = scratch.table(pools.select("id", "key", "n"), "every")
    smallest = percent // (100 - percent)  # smaller sets only link with equal ones
    classes = every.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    copies = every.select("id", "key").join(classes.withColumnRenamed("id", "least"), "key").where("id > least").select("id", "key").distinct()
    copies = _sized(scratch.table(copies, "copies"))
    first = lambda sets: sets.where(F.col("id").isNotNull() & (F.col("n") >= smallest)).join(copies, ["id", "key"], "left_anti")
    sets = first(pools).select("id", "n", *SKETCH, "pool")

    # the global order, and the size from which inverted lists are cheaper than subsets
    counts = scratch.table(sets.select(F.explode("pool").alias("s")).groupBy("s").count().where("count > 1"), "counts")
    heavy = _sized(counts.where(F.col("count") >= HEAVY).select("s"))
    total = sets.agg(F.sum(F.size("pool")).alias("t")).first()["t"] or 0
    more = counts.where(F.col("count") < HEAVY).agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count")).alias("cc")).first()
    scan = (total - (more["c"] or 0) + (more["cc"] or 0)) / max(total, 1)
    longest = int(2 * scan) - 1  # a prefix of p elements has p * (p + 1) / 2 subsets, and scans p lists
    border = max(smallest, (longest * 100) // (100 - percent))

    # each set has a number, as an id may have several sets
    near = scratch.table(_prefixes(sets, heavy, percent).withColumn("row", F.monotonically_increasing_id()), "near")
    scratch.free("every", "copies", "counts", "near")
    short = _sized(near.where("not full").select("id").distinct())
    far = _prefixes(first(_sets(source.join(short, "id", "left_semi"), width, percent, True)).select("id", "n", *SKETCH, "pool"), heavy, percent)
    far = scratch.table(far.withColumn("row", -1 - F.monotonically_increasing_id()), "far")
    cut = near.where("full").unionByName(far).drop("full")

    # most entries are alone in their list: only numbers of sets are shuffled with them, sizes and sketches join the rest
    single = cut.where(F.col("n") >= border * percent // 100).select("row", F.posexplode(F.expr("slice(pre, 1, p)")).alias("i", "s")).select("row", "i", F.xxhash64(F.lit(1), "s").alias("sig"))
    firsts = F.expr("slice(pre, 1, p + 1)").alias("pre")
    subsets = "flatten(transform(pre, (x, i) -> transform(slice(pre, i + 2, size(pre)), (y, k) -> struct(i + 1 + k as i, xxhash64(2, least(x, y), greatest(x, y)) as sig))))"
    double = cut.where(F.col("n") < border).select("row", firsts).select("row", F.inline(F.expr(subsets)))
    entries = single.unionByName(double)
    lists = entries.groupBy("sig").count().where("count > 1").select("sig")
    shared = scratch.table(entries.join(lists, "sig"), "shared")
    members = scratch.table(shared.join(cut.select("row", "id", "n", *SKETCH), "row").drop("row"), "members")
    kept = ("every", "near", "far", "members")
    scratch.free(*kept)
    # of several members the one with the shared shingle earliest stands for them: it has few rare ones, so it is nearest to
    # what they have in common
    other = {"id": "b", "n": "m", "i": "j"} | {c: f"{c}2" for c in SKETCH}
    pivots = members.groupBy("sig").agg(F.min_by(F.struct(*(F.col(c).alias(d) for c, d in other.items())), F.struct("i", "id")).alias("x")).select("sig", "x.*")

    # turn 0: each member with one pivot; turn 1: what that leaves apart, of long lists the nearest members of each two
    # components; turn 2: all that is still apart in long lists
    pairs = members.join(pivots, "sig").where(f"id != b and {_fits(percent)}").select(F.col("id").alias("a"), "b").distinct()
    pairs = _possible(scratch.table(pairs, "cross"), cut, percent).groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = tried = None
    for turn in range(3):
        pairs = scratch.table(pairs, f"pairs{turn}")
        ids = _sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        texts = source.join(ids, "id", "left_semi")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        found = _linked(both, width, percent)
        links = scratch.table(found if links is None else links.unionByName(found), f"links{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        parts = scratch.table(components(links, scratch, f"turn{turn}"), f"parts{turn}")
        scratch.free(*kept, *(f"{x}{k}" for x in ("pairs", "links", "parts") for k in range(turn + 1)))
        if turn == 2:
            break
        # lists whose members lie in several components; after turn 1 the short ones are done
        named = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = named.groupBy("sig").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig", "size")
        mixed = scratch.table(mixed if turn == 0 else mixed.where(F.col("size") > LISTED), f"mixed{turn}")
        if mixed.isEmpty():
            break
        # each step is written, so that no two of them shuffle at a time
        held = scratch.table(named.join(mixed, "sig"), f"held{turn}")
        long = mixed.where(F.col("size") > LISTED)
        chunked = scratch.table(_with_before(held.where(F.col("size") > LISTED).drop("size"), long, cut), f"chunked{turn}")
        cross = _chunk_pairs(chunked, long, percent, turn == 0)
        if turn == 0:
            short = held.where(F.col("size") <= LISTED)
            right = short.select("sig", F.col("component").alias("component2"), *(F.col(c).alias(d) for c, d in other.items()))
            listed = short.join(right, "sig").where(f"id > b and component != component2 and {_fits(percent)}").select(F.col("id").alias("a"), "b")
            cross = cross.unionByName(listed)
        cross = scratch.table(cross.distinct().join(tried, ["a", "b"], "left_anti"), f"cross{turn}")
        pairs = _possible(cross, cut, percent).select("a", "b")

    scratch.free("every", f"parts{turn}")
    of_set = classes.join(parts, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("component"))
    out = every.select("id", "key", "n").join(of_set, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
