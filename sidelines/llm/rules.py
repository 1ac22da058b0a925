"""Quality rules: an ordered decision list of threshold conjunctions, learned by sequential covering."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import cut, learning_rows
from sidelines.llm.stats import ratios, statistics

#: Most labelled rows that are learned from, thresholds tried for each column, conditions in a rule, rules in a list.
MOST_ROWS, THRESHOLDS, CONDITIONS, RULES = 20_000, 24, 3, 12


@dataclass(frozen=True)
class Rule:
    """A text is rejected if all conditions (column, is it at least, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, value in self.conditions:
            out = out & ((F.col(name) >= value) if above else (F.col(name) < value))
        return out


def _holds(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, value in conditions:
        out &= x[name] >= value if above else x[name] < value
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, tests: list) -> list:
    conditions, covered = [], np.ones(len(bad), bool)
    while len(conditions) < CONDITIONS:
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        if not p or not n:
            break
        base, best, found = np.log2(p / (p + n)), 0.0, None
        for test in tests:
            held = covered & _holds(x, [test])
            a, b = (held & bad).sum(), (held & ~bad).sum()
            if a and (gain := a * (np.log2(a / (a + b)) - base)) > best:
                best, found = gain, test
        if found is None:
            break
        conditions.append(found)
        covered &= _holds(x, [found])
    return conditions


def _worth(x, bad, conditions) -> float:
    held = _holds(x, conditions)
    p, n = (held & bad).sum(), (held & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, seed: int = 3) -> list[Rule]:
    """Rules for the rows marked bad, in order. Each is grown on two thirds of what earlier ones leave, pruned on the rest
    from its last condition back, and ends the list if it doesn't reach least_precision there."""
    tests = []
    for name, values in x.items():
        cuts = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, THRESHOLDS)), np.quantile(values[bad], np.linspace(0, 1, THRESHOLDS))])) if bad.any() else []
        tests += [(name, above, float(v)) for v in cuts for above in (True, False)]
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    grown_on = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    while len(rules) < RULES and (left & bad & grown_on).sum() >= 3:
        a, b = ({k: v[left & part] for k, v in x.items()} for part in (grown_on, ~grown_on))
        bad_a, bad_b = bad[left & grown_on], bad[left & ~grown_on]
        conditions = _grow(a, bad_a, tests)
        while len(conditions) > 1 and _worth(b, bad_b, conditions[:-1]) >= _worth(b, bad_b, conditions):
            conditions = conditions[:-1]
        held = _holds(b, conditions) if conditions else np.zeros(0, bool)
        precision = bad_b[held].mean() if held.any() else 0.0
        if not conditions or precision < least_precision:
            break
        rules.append(Rule(tuple(conditions), float(precision)))
        left &= ~_holds(x, conditions)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds: CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
    out = F
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def learned_rules(stats: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> list[Rule]:
    """The list learned from at most about `most` rows of statistics() with a label outside the held-out fold."""
    values = ratios()
    sample = stats.join(F.broadcast(learning_rows(labels, "quality", most)), "doc_id").select("label", *(c.cast("double").alias(k) for k, c in values.items())).toPandas()
    sample = sample.sort_values(["label", *values], ignore_index=True)  # the order decides what is grown on and what pruned on
    return learn({k: sample[k].to_numpy(float) for k in values}, sample["label"].to_numpy() == 0)


def quality_rules(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row of
    docs(doc_id, text). base_failed: under 50 words, or over half of them in repeated three-word windows. kept: not
    base_failed, and no rule of the list learned from labels(doc_id, quality) outside the held-out fold (at most about
    `most` rows) rejects it. Null or empty texts have no words and fail; null doc_ids and repeated rows are judged like
    any other; without labels the list is empty.
    """
    stats = cut(statistics(docs), "stats")
    values, rules = ratios(), learned_rules(stats, labels, most)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.withColumns({k: c.cast("double") for k, c in values.items()})
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
    )
