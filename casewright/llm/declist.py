"""Quality rules as a learned decision list.

Sequential covering: a rule is grown on one part of the labelled documents, condition by
condition, by information gain; pruned on the other part; kept if it is precise there; and the
documents that it covers are set aside before the next is grown. The list becomes one ordered
Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import stored
from casewright.llm.stats import FEATURES, feature, text_statistics

#: Labelled documents that a list is learned from at most; a bounded sample by hash.
SAMPLE = 40_000
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 4, 48
#: A rule must be so precise on the documents it is pruned on, and cover so many of them.
PRECISION, COVERED = 0.9, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.cut if self.above else table[self.feature] <= self.cut

    def column(self) -> Column:
        return feature(self.feature) > self.cut if self.above else feature(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if p == 0 or n == 0:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in table.items():
            grid = cuts[name]
            place = np.searchsorted(grid, values[inside], "left")  # cuts below each value
            low_p = np.cumsum(np.bincount(place[bad[inside]], minlength=len(grid) + 1))[:-1]
            low_n = np.cumsum(np.bincount(place[~bad[inside]], minlength=len(grid) + 1))[:-1]
            for above, cp, cn in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(grid[k])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= best[1].holds(table)
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The best beginning of a rule with its precision and the bad documents it covers."""
    best, inside = ((), 0.0, 0), np.ones(len(bad), bool)
    worth = -1.0
    for k, condition in enumerate(rule):
        inside &= condition.holds(table)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth + 1e-3:
            worth, best = value, (rule[: k + 1], p / (p + n), p)
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Ordered rules for ``bad`` documents; ``prune`` marks those that rules are pruned on."""
    cuts = {name: np.unique(np.quantile(v, np.linspace(0, 1, CUTS))) if len(v) else np.zeros(1) for name, v in table.items()}
    for name, values in table.items():  # and the range in which bad documents lie
        if bad.any():
            cuts[name] = np.unique(np.concatenate([cuts[name], np.quantile(values[bad], np.linspace(0, 1, CUTS))]))
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES:
        grow = left & ~prune
        rule = _grow({k: v[grow] for k, v in table.items()}, bad[grow], cuts)
        check = left & prune
        rule, precision, covered = _prune(rule, {k: v[check] for k, v in table.items()}, bad[check])
        if not rule or precision < PRECISION or covered < COVERED:
            break
        rules.append(rule)
        left &= ~_covers(rule, table)
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the first rule that holds or null) as ordered conditional expressions."""
    number = F.lit(None).cast("int")
    if rules:
        chain = None
        for k, rule in enumerate(rules):
            holds = rule[0].column()
            for condition in rule[1:]:
                holds = holds & condition.column()
            chain = F.when(holds, F.lit(k)) if chain is None else chain.when(holds, F.lit(k))
        number = chain.otherwise(number)
    return number.isNull(), number


def fit(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from rows of ``labels`` (doc_id, quality) joined with ``text_statistics``.

    At most about ``sample`` labelled documents are used, chosen by a hash of the id; ids that
    are null or repeated in ``labels`` with two qualities are left out.
    """
    sure = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
    total = sure.count()
    share = min(1.0, sample / max(total, 1))
    mix = F.pmod(F.xxhash64("doc_id", F.lit("declist")), F.lit(1_000_000))
    chosen = sure.filter(mix < int(share * 1_000_000)).select("doc_id", "lo")
    rows = counted.join(chosen, "doc_id").select(
        "doc_id", "lo", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        *[feature(name).alias(name) for name in FEATURES],
    ).toPandas().sort_values("doc_id", kind="stable")
    table = {name: rows[name].to_numpy(float) for name in FEATURES}
    return learn(table, (rows["lo"] == 0).to_numpy(bool), rows["prune"].to_numpy(bool))


def judge(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of every row, ``base_failed``, ``rule`` (number of the rule met, or null), ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated 5-word windows.
    Null and empty texts count 0 words and fail. Without labelled bad documents there is no
    rule and the base decides alone. Repeated rows are judged each; other columns are not read.
    """
    counted = stored(text_statistics(df))
    kept, number = verdict(fit(counted, labels, sample))
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return counted.select("*", base.alias("base_failed"), number.alias("rule"), (~base & kept).alias("kept"))
