"""Quality rules as a learned decision list: sequential covering with grow and prune, run as a Spark CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import free_name, labelled_sample
from quillmesh.llm.text_stats import COUNTS, RATIOS, text_stats

#: Labelled documents to learn from, at most.
SAMPLE = 12_000
#: Ratios that fall or rise with a text's length alone; rules on them would reject long clean texts.
LENGTH_BOUND = {"distinct_share", "log_words"}
#: The fixed rules at the head of the list.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _cover(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, longest: int) -> Rule:
    """Adds the condition with the largest information gain until no good document is covered."""
    rule: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(rule) < longest and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            v = x[live, j]
            at = np.unique(np.quantile(v[bad[live]], np.linspace(0, 1, cuts)))
            order = np.sort(v[bad[live]]), np.sort(v[~bad[live]])
            for above in (True, False):
                p, n = (len(o) - np.searchsorted(o, at, "left") if above else np.searchsorted(o, at, "right") for o in order)
                got = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(got))
                if got[k] > gain:
                    best, gain = (name, above, j, float(at[k]), order), float(got[k])
        if best is None:
            break
        name, above, j, cut, (p, n) = best
        # the middle of the gap to the nearest good document generalises better than the edge of the bad ones
        if above and len(side := n[n < cut]):
            cut = (cut + float(side[-1])) / 2
        elif not above and len(side := n[n > cut]):
            cut = (cut + float(side[0])) / 2
        rule.append(Condition(name, above, cut))
        live &= rule[-1].mask(x, names)
    return tuple(rule)


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, cuts: int = 64, longest: int = 4, most: int = 24) -> list[Rule]:
    """Ordered rules that reject. Two thirds of the rows grow a rule, the others prune it.

    A rule is kept while, on rows that earlier rules leave, its precision over all of them is at least ``precision``.
    No rows, or rows of one class, give no rule.
    """
    rules: list[Rule] = []
    grows = np.arange(len(x)) % 3 != 0
    left = np.ones(len(x), bool)
    while len(rules) < most and (left & bad & grows).any() and (left & ~bad).any():
        rule = _grow(x[left & grows], bad[left & grows], names, cuts, longest)
        if not rule:
            break
        px, pb = x[left & ~grows], bad[left & ~grows]

        def worth(r: Rule) -> float:
            hit = _cover(r, px, names)
            p, n = int((hit & pb).sum()), int((hit & ~pb).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = left & _cover(rule, x, names)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < 2 or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_column(rules: list[Rule]) -> Column:
    """The text of the first rule that fires, else null, as one ordered CASE expression."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        text = F.lit(" and ".join(map(str, rule)))
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.lit(None).cast("string") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, **options) -> list[Rule]:
    """Learns from at most ``bound`` labelled documents; label 0 marks what to reject."""
    sample = text_stats(labelled_sample(docs, labels, label, bound), "doc_id", "y")
    names = [n for n in RATIOS if n not in LENGTH_BOUND]
    rows = sample.where(f"not ({BASE_FAILED})").orderBy("doc_id", *names).toPandas()
    return learn(rows[names].to_numpy(np.float64), (rows["y"] == 0).to_numpy(bool), names, **options)


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, **options) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and the rule that fired, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: under 10 words, or over 20 % of words in repeated 5-word windows.
    Null and empty texts have zero counts and fail the base. Repeated rows are judged alike; null ids stay null;
    empty tables give no rows; other columns are ignored. Without usable labels only the base rules hold.
    """
    return rule_verdicts(docs, fit(docs, labels, bound=bound, **options), ["doc_id"])


def rule_verdicts(docs: DataFrame, rules: list[Rule], carry: list[str]) -> DataFrame:
    """``carry`` columns, COUNTS, base_failed, kept and the rule that fired; ``carry`` may hold the text itself. A verdict
    column whose name ``carry`` has gets underscores behind it."""
    names = {c: f"_carry{k}" for k, c in enumerate(carry)}  # no clash with the statistics' names
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *["text"] * ("text" not in names))
    judged = text_stats(rows, *names.values(), text=names.get("text", "text")).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", rule_column(rules))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.select(*(F.col(n).alias(c) for c, n in names.items()), *(F.col(c).alias(free_name(c, carry)) for c in [*COUNTS, "base_failed", "kept", "rule"]))
