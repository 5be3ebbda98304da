"""URL filter: host and path rules first, then the ratio of two character language models.

URLs that the rules accept or reject train one smoothed variable-order Markov model each: a character's estimate uses the
longest context before it, of up to DEPTH characters, that training has seen often enough, mixed with those of the shorter
ones. A URL that no rule fits is judged by the difference of its log-likelihoods per character, against a threshold that
parts held-out accepted URLs from held-out rejected ones best. Everything is DataFrame expressions over gram codes; URLs
themselves are carried by no gram row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Scratch

#: Characters that the models tell apart; any other is code 0, the start of a URL is code 1.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~/%=&+:@!,;()*'$"
SIZE = len(ALPHABET) + 2
#: Characters of the longest context.
DEPTH = 4
#: A context counts if training has seen it so often; rarer ones leave the estimate to the shorter context.
LEAST = 8
#: Weight of the shorter context in the longer one's estimate.
MIX = 4.0
#: Labelled URLs whose md5 starts with a digit below this one are held out for the threshold.
HELD_BELOW = "4"
#: Decimals of the scores that the threshold is searched over, so that there are few.
DECIMALS = 2
#: A side of up to this many short rows is broadcast after counting it; a larger one is shuffled.
SMALL_SIDE = 200_000

Rule = tuple[str, str, bool]
ID = ["id1", "id2"]


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE else df


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty where it is null or lacks ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(rules: list[Rule]) -> Column:
    """The rule that fits host and path as a struct (rule, allow), the longest first; null if none does."""
    tests = []
    for host, path, allow in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        tests.append(F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(allow).alias("allow"))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,allow:boolean>")


def _codes(text: Column) -> Column:
    """Codes of a text's characters after DEPTH start codes."""
    letters = F.filter(F.split(F.regexp_replace(text, r"[^\x00-\x7F]", "?"), ""), lambda c: F.length(c) > 0)
    at = F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)).cast("bigint"))
    return F.concat(F.array_repeat(F.lit(1).cast("bigint"), DEPTH), F.transform(at, lambda x: F.when(x > 0, x + 1).otherwise(F.lit(0).cast("bigint"))))


def _grams(urls: DataFrame, *carry: str) -> DataFrame:
    """One row per character: ``g`` codes it with the DEPTH before it, ``g % SIZE**(k + 1)`` with the k before it."""
    code = " + ".join(f"x[i + {j}] * {SIZE ** (DEPTH - j)}L" for j in range(DEPTH + 1))
    return urls.select(*carry, F.explode(F.expr(f"transform(sequence(0, size(x) - {DEPTH + 1}), i -> {code})")).alias("g"))


def _by_depth(grams: DataFrame, *carry: str) -> DataFrame:
    """Each gram with each number ``k`` of context characters: ``key`` codes context and character, ``context`` the former."""
    power = f"element_at(array({', '.join(f'{SIZE ** k}L' for k in range(1, DEPTH + 2))}), k + 1)"
    rows = grams.select("g", *carry, F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("k"))
    rows = rows.select("g", *carry, "k", F.expr(f"g % {power}").alias("key"))
    return rows.withColumn("context", F.expr(f"key div {SIZE}"))


def _log_ratios(grams: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, ratio) for each distinct ``g`` of ``grams``: log of the accepted model's over the rejected model's estimate."""
    both = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    seen = scratch.table(_by_depth(counts, "good", "bad").groupBy("k", "key", "context").agg(*both), "seen")
    contexts = seen.groupBy("k", "context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    rows = _by_depth(grams.select("g").distinct()).join(_sized(seen.drop("context")), ["k", "key"], "left").join(_sized(contexts), ["k", "context"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    levels = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", *map(zero, ("good", "bad", "all_good", "all_bad"))))).alias("levels"))  # DEPTH + 1 each

    def estimate(side: str) -> str:
        longer = f"if(x.all_{side} >= {LEAST}, (x.{side} + {MIX}D * p) / (x.all_{side} + {MIX}D), p)"
        return f"aggregate(levels, 0.0D, (p, x) -> if(x.k = 0, (x.{side} + 0.5D) / (x.all_{side} + {0.5 * SIZE}D), {longer}))"

    return levels.select("g", F.expr(f"ln({estimate('good')}) - ln({estimate('bad')})").alias("ratio"))


def _threshold(held: DataFrame) -> DataFrame:
    """One row: ``edge``, the middle of the gap below the smallest score that parts accepted from rejected URLs best, by the sum
    of the shares on the right side; 0, where both models are equally likely, if one kind is missing."""
    steps = held.groupBy(F.round("score", DECIMALS).alias("s")).agg(F.sum(F.when(F.col("allow"), F.col("copies")).otherwise(0)).alias("good"), F.sum(F.when(F.col("allow"), 0).otherwise(F.col("copies"))).alias("bad"))
    # the range of log ratios over 10**DECIMALS bounds the distinct scores
    steps = steps.agg(F.array_sort(F.collect_list(F.struct("s", "good", "bad"))).alias("steps"))
    total = lambda part, c: f"aggregate({part}, 0L, (a, x) -> a + x.{c})"
    right = f"round(1.0D - {total('slice(steps, 1, i)', 'good')} / cast(good as double) + {total('slice(steps, 1, i)', 'bad')} / cast(bad as double), 9)"
    steps = steps.withColumns({c: F.expr(total("steps", c)) for c in ("good", "bad")})
    best = f"array_max(transform(steps, (x, i) -> struct({right} as j, -i as at)))"
    steps = steps.withColumn("at", F.expr(f"if(good > 0 and bad > 0, -({best}).at, null)"))
    return steps.select(F.expr("case when at is null then 0.0D when at = 0 then steps[0].s else (steps[at - 1].s + steps[at].s) / 2.0D end").alias("edge"))


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of ``pages``.

    ``rules`` are (host, path prefix, allow); the longest that fits decides. Other URLs are allowed where the mean log ratio
    of their characters, ``score``, is at or above the threshold. Of the URLs that rules decide, those held out by their md5
    set the threshold and the others train the models, each row counted. Where the rules leave one model without training
    there is no model, and such URLs are allowed, as are null and malformed ones, whose host and path are empty. Repeated
    rows are judged alike; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    urls = urls.withColumn("hit", matching_rule(rules)).withColumns({c: F.xxhash64(F.lit(k), "host", "path") for k, c in enumerate(ID)})

    # a host holds no slash and a path starts with one, so the joined text stands for both
    held = F.substring(F.md5(F.concat("host", "path")), 1, 1) < HELD_BELOW
    distinct = urls.where("length(host) + length(path) > 0").groupBy(*ID, F.col("hit.allow").alias("allow")).agg(F.count("*").alias("copies"), F.first(F.concat("host", "path")).alias("text"), F.first(held).alias("held"))
    distinct = scratch.table(distinct.select(*ID, "allow", "copies", F.col("allow").isNotNull() & ~F.col("held"), _codes(F.col("text"))).toDF(*ID, "allow", "copies", "trains", "x"), "urls")
    side = lambda allow: F.sum(F.when(F.col("allow") == allow, F.col("copies")).otherwise(0))
    counts = scratch.table(_grams(distinct.where("trains"), "allow", "copies").groupBy("g").agg(side(True).alias("good"), side(False).alias("bad")), "counts")
    grams = _grams(distinct.where("not trains"), *ID)
    ratios = scratch.table(_log_ratios(grams, counts, scratch), "ratios")
    scores = grams.join(_sized(ratios), "g").groupBy(*ID).agg(F.round(F.avg("ratio"), 9).alias("score"))
    scores = scratch.table(scores.join(_sized(distinct.where("not trains").select(*ID, "allow", "copies")), ID), "scores")

    scratch.free("counts", "scores")
    usable = counts.agg(F.coalesce(F.sum("good") > 0, F.lit(False)).alias("g"), F.coalesce(F.sum("bad") > 0, F.lit(False)).alias("b"))
    edge = _threshold(scores.where("allow is not null")).join(F.broadcast(usable)).select(F.when(F.col("g") & F.col("b"), F.col("edge")).alias("edge"))
    out = urls.join(_sized(scores.where("allow is null").select(*ID, "score")), ID, "left").join(F.broadcast(edge))  # one row
    model = F.when(F.col("score") < F.col("edge"), "block").otherwise("allow")
    verdict = F.when(F.col("hit.allow"), "allow").when(~F.col("hit.allow"), "block").otherwise(model)
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
