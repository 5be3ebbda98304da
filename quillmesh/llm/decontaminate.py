"""Benchmark decontamination with DataFrame expressions alone: SimHash of item-sized windows, multi-index Hamming blocks,
then an exact weighted-shingle similarity.

A window of similarity 0.8 holds one of an item's heaviest shingles, its anchors. So only windows that cover an anchor of
some item of their size are fingerprinted, at every offset; the others can't be similar to any item. Fingerprints then find
their items by a join on block keys: an item is listed under every value within BLOCK_RADIUS bits of each of its blocks, and
two fingerprints within RADIUS bits agree so far in one block at least. The exact similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch

#: Similar windows differ in about 13 of 64 bits, with a deviation of 3; four deviations more are admitted.
BITS, BLOCKS, RADIUS = 64, 8, 27
#: Of BLOCKS blocks one differs in so many bits at most.
BLOCK_BITS, BLOCK_RADIUS = BITS // BLOCKS, RADIUS // BLOCKS
#: Patterns of so few bits.
_NEAR = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]
#: The low bits of a shingle, its characters: no text has more.
WEIGHT = (1 << 31) - 1
#: A side of up to this many short rows is broadcast after counting it; a larger one is shuffled.
SMALL_SIDE = 200_000
#: Of so many items of one size their shingles are listed to rule windows out before they are fingerprinted.
MANY = 100
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _sized(df: DataFrame, bound: int = SMALL_SIDE) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), upper + _SEPARATORS, upper.lower() + " " * len(_SEPARATORS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(words: str, width: int) -> str:
    """SQL: the hash of each window of ``width`` words, its lowest 31 bits replaced by the window's characters."""
    parts, sizes = [f"pw[i + {j}]" for j in range(width)], [f"pl[i + {j}]" for j in range(width)]
    each = f"transform(sequence(0, size(pw) - {width}), i -> (xxhash64({', '.join(parts)}) & {~WEIGHT}L) | ({' + '.join(sizes)}))"
    packed = _let("pl", "transform(ws, q -> cast(length(q) as bigint))", f"if(size(pw) >= {width}, {each}, cast(array() as array<bigint>))")
    return _let("ws", words, _let("pw", "transform(ws, q -> xxhash64(q))", packed))


def _multiset(shingles: str) -> str:
    """SQL: shingles told apart by how often they came before, so that set operations count copies; weights stay."""
    return _let("so", f"sort_array({shingles})", f"transform(so, (q, qi) -> (xxhash64(q, qi - array_position(so, q)) & {~WEIGHT}L) | (q & {WEIGHT}L))")


def _weight(shingles: str) -> str:
    return f"aggregate({shingles}, 0L, (a, h) -> a + (h & {WEIGHT}L))"


def _simhash(shingles: str) -> str:
    """SQL: the fingerprint whose bits are those that more than half of the weight has.

    The weights of four bits, 16 places apart, add up in one integer of four lanes; a weight of 2^15 or more is scaled down.
    """
    lanes = "transform(sequence(0, 15), j -> aggregate(sh, 0L, (a, x) -> a + (shiftrightunsigned(x.h, j) & 281479271743489L) * x.w))"
    bits = " | ".join(f"if(2 * (shiftrightunsigned(v, {k}) & 65535L) > t, shiftleft(1L, j + {k}), 0L)" for k in (0, 16, 32, 48))
    whole = _let("t", "aggregate(sh, 0L, (a, x) -> a + x.w)", f"aggregate(transform({lanes}, (v, j) -> {bits}), 0L, (a, x) -> a | x)")
    scaled = f"transform(hs, q -> struct(xxhash64(q) as h, if(raw < 32768, q & {WEIGHT}L, (q & {WEIGHT}L) * 32767 div raw) as w))"
    return _let("hs", shingles, _let("raw", _weight("hs"), _let("sh", scaled, whole)))


def _block(fingerprint: str, j: int) -> str:
    return f"(shiftrightunsigned({fingerprint}, {j * BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L)"


def _keys(fingerprint: str) -> str:
    """SQL: block number and bits of each block, as one integer."""
    return f"array({', '.join(f'{_block(fingerprint, j)} + {j << BLOCK_BITS}L' for j in range(BLOCKS))})"


def _agreeing(x: str) -> str:
    """SQL: number of the first block of the difference ``x`` with BLOCK_RADIUS bits at most; null if there is none."""
    return "case " + " ".join(f"when bit_count({_block(x, j)}) <= {BLOCK_RADIUS} then {j}" for j in range(BLOCKS)) + " end"


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, similarity, start of the best window for each document and benchmark item that it leaks.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window has as many words as the item, or
    the document's where that is shorter. Shingles have ``width`` words, or all of an item's if it has fewer, and weigh their
    characters. The similarity is the shared weight over the larger of both weights; pairs reach ``percent`` % of it.
    Items and documents without words leak nothing; rows without an id are left out; rows of one id count as one document;
    ties go to the first window. Empty tables give no rows; other columns are ignored.
    """
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text")).alias("iw")).where("size(iw) > 0")
    bench = bench.withColumn("m", F.size("iw")).withColumn("k", F.least("m", F.lit(width)))
    lengths = [r["k"] for r in bench.select("k").distinct().collect()]  # at most ``width`` numbers
    found = None
    for k in sorted(lengths):
        one = _leaks(source, bench.where(F.col("k") == k), k, percent)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return source.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start")).where("false")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("start"))


def _known(bench: DataFrame) -> DataFrame:
    """(m, known): the shingles of the items of each size; null for sizes of more than MANY items, whose windows are all tried."""
    few = bench.groupBy("m").agg(F.count("*").alias("items")).where(F.col("items") <= MANY).select("m")
    return bench.join(few, "m").groupBy("m").agg(F.array_distinct(F.flatten(F.collect_list("ih"))).alias("known"))


def _leaks(source: DataFrame, bench: DataFrame, k: int, percent: int) -> DataFrame:
    bench = bench.withColumn("ih", F.expr(_shingles("iw", k))).withColumn("total", F.expr(_weight("ih")))
    # anchors: the heaviest shingles, until those left weigh less than a similar window needs
    spots = bench.select("item_id", "m", "total", F.explode("ih").alias("h"))
    size = F.expr(f"h & {WEIGHT}L")
    each = spots.groupBy("item_id", "m", "total", "h").agg(F.sum(size).alias("weight"))
    ranked = each.groupBy("item_id", "m", "total").agg(F.array_sort(F.collect_list(F.struct((-size).alias("w"), "h", "weight"))).alias("all"))
    before = f"aggregate(slice(all, 1, i), 0L, (a, y) -> a + y.weight) <= total * {100 - percent} / 100.0d"
    anchors = ranked.select("m", F.explode(F.expr(f"filter(all, (x, i) -> {before})")).alias("x")).select("m", F.col("x.h").alias("h")).distinct()

    hashes = source.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.expr(_shingles("w", k)).alias("hs"))
    places = hashes.select("doc_id", (F.size("hs") + k - 1).alias("n"), F.posexplode("hs").alias("pos", "h"))
    # starts whose window covers the anchor, in blocks of m starts, so that hits beside each other are one row before the shuffle
    block = f"explode(sequence(cast(greatest(0, pos - m + {k}) div m as int), cast(least(pos, greatest(0, n - m)) div m as int)))"
    starts = places.join(_sized(anchors), "h").select("doc_id", "m", F.expr(block).alias("block")).distinct()
    # blocks are few: where counting proves it they go to the texts, else both are shuffled
    windows = _sized(Scratch(source.sparkSession).table(starts, "windows"))
    texts = source.join(windows, "doc_id").withColumn("w", words_of(F.col("text"))).join(_sized(_known(bench), SMALL_SIDE // 50), "m", "left")
    spans = texts.select("doc_id", "m", "block", "known", F.expr(_shingles("slice(w, block * m + 1, 2 * m - 1)", k)).alias("seg"), F.expr(f"least(m, size(w)) - {k - 1}").alias("g"))
    # a window shares no more than those of its shingles that some item of its size has
    running = lambda c: f"aggregate({c}, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x))"
    enough = f"filter(sequence(0, size(sg) - g), s -> 100 * (met[s + g] - met[s]) >= {percent} * (own[s + g] - own[s]))"
    weights = [running(f"transform(sg, x -> {x})") for x in (f"x & {WEIGHT}L", f"if(array_contains(common, x), x & {WEIGHT}L, 0L)")]
    tried = _let("common", "if(known is null, sg, array_intersect(sg, known))", _let("own", weights[0], _let("met", weights[1], enough)))
    each = spans.select("doc_id", "m", "block", "seg", "g", F.expr(f"explode(if(g > 0 and size(seg) >= g, {_let('sg', 'seg', tried)}, null))").alias("s"))
    prints = each.select("doc_id", "m", F.expr("block * m + s").alias("start"), F.expr("slice(seg, s + 1, g)").alias("h"))

    # the multi-index: of each two fingerprints that agree in several blocks the first one joins them
    index = bench.select("item_id", "m", "total", "ih", F.expr(_multiset("ih")).alias("im"), F.expr(_simhash("ih")).alias("ifp"))
    around = f"explode(flatten(transform({_keys('ifp')}, key -> transform(array({', '.join(f'{x}L' for x in _NEAR)}), x -> key ^ x))))"
    keys = _sized(index.select("item_id", "m", "ifp", F.expr(around).alias("key")))
    marks = _let("f", _simhash("h"), f"transform({_keys('f')}, key -> struct(f as fp, key))")
    met = prints.select("*", F.expr(f"explode({marks})").alias("x")).select("doc_id", "m", "start", "h", "x.fp", "x.key").join(keys, ["m", "key"])
    near = met.where(f"bit_count(fp ^ ifp) <= {RADIUS} and {_agreeing('(fp ^ ifp)')} = key div {1 << BLOCK_BITS}").select("doc_id", "item_id", "start", "h")

    both = near.join(_sized(index.select("item_id", "total", "ih", "im"), SMALL_SIDE // 50), "item_id").withColumn("own", F.expr(_weight("h")))
    # no window shares more than its shingles of the item, each copy counted; without repeated shingles it is just that
    both = both.withColumn("top", F.expr(_weight("filter(h, x -> array_contains(ih, x))"))).where(f"100 * top >= {percent} * greatest(total, own)")
    shared = F.expr(f"if(size(array_distinct(h)) = size(h), top, {_weight(f'array_intersect(im, {_multiset("h")})')})")
    scored = both.select("doc_id", "item_id", "start", shared.alias("shared"), F.expr("greatest(total, own)").alias("most"))
    return scored.where(f"100 * shared >= {percent} * most").select("doc_id", "item_id", "start", F.round(F.col("shared") / F.col("most"), 6).alias("similarity"))
