"""Quality rules: a decision list learned by sequential covering from labelled statistics, and emitted
as one ordered Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .text_stats import labelled_sample, stats

#: name -> numerator, denominator (counts of text_stats)
RATES = {
    "symbol_rate": ("n_symbols", "word_chars"), "repeat_rate": ("n_repeat_words", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"), "upper_rate": ("n_upper", "word_chars"),
    "upper_word_rate": ("n_upper_words", "n_words"), "bar_rate": ("n_bars", "n_words"), "mark_rate": ("n_marks", "n_words"),
    "stop_rate": ("n_stops", "n_words"), "distinct_rate": ("n_distinct_words", "n_words"),
    "common_rate": ("most_common", "n_words"), "digit_rate": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self, row: str) -> Column:
        n, d = RATES[self.name]
        value = F.col(f"{row}.{n}") / F.greatest(F.col(f"{row}.{d}"), F.lit(1))
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(RATES).index(self.name)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, y: np.ndarray, grid: dict[str, np.ndarray], most: int) -> Rule:
    """Add the condition of the largest FOIL gain until no kept document is covered or none gains."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (y[inside] == 0).any():
        p, n = int(y[inside].sum()), int((~y[inside].astype(bool)).sum())
        if not p:
            break
        before, best, pick = np.log2(p / (p + n)), 1e-9, None
        for name, cuts in grid.items():
            for t in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    hit = inside & c.holds(x)
                    q = int(y[hit].sum())
                    if q and (gain := q * (np.log2(q / int(hit.sum())) - before)) > best:
                        best, pick = gain, c
        if pick is None:
            break
        rule += (pick,)
        inside &= pick.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The prefix of the rule that does best on the rows held for pruning: (p - n) / (p + n)."""
    best, kept = -np.inf, rule
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], x)
        p, n = int(y[hit].sum()), int(hit.sum() - y[hit].sum())
        if p + n and (worth := (p - n) / (p + n)) > best:
            best, kept = worth, rule[:k]
    return kept


def _centred(rule: Rule, x: np.ndarray) -> Rule:
    """The rule with each threshold half-way between the values beside it: it covers the same rows of
    ``x`` and spares texts that come just short of those it was learned from."""
    out = []
    for c in rule:
        v = x[:, list(RATES).index(c.name)]
        low, high = v[v <= c.threshold], v[v > c.threshold]
        out.append(Condition(c.name, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c)
    return tuple(out)


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.9, least: int = 5, rules: int = 16, conditions: int = 4) -> list[Rule]:
    """Rules that reject, in the order found. ``y``: 1 for a document to reject.

    Every third row prunes, the others grow. A rule is taken if at least ``precision`` of what it
    covers, over both parts, is to be rejected and it covers ``least`` such rows; what it covers
    leaves both parts. Too few rows, or rows of one label, give no rule.
    """
    prune = np.arange(len(y)) % 3 == 2
    out: list[Rule] = []
    while len(out) < rules and y[~prune].sum() >= least and (y == 0).any():
        gx, gy = x[~prune], y[~prune]
        cuts = {}
        for i, name in enumerate(RATES):
            v = np.unique(np.quantile(gx[gy == 1, i], np.linspace(0, 1, 17)))
            cuts[name] = np.unique(np.concatenate([v, np.quantile(gx[:, i], np.linspace(0.02, 0.98, 13))]))
        rule = _prune(_grow(gx, gy, cuts, conditions), x[prune], y[prune])
        hit = _covers(rule, x)
        if not rule or y[hit].sum() < least or y[hit].mean() < precision:
            break
        out.append(_centred(rule, x))
        x, y, prune = x[~hit], y[~hit], prune[~hit]
    return out


def base_failed(row: str) -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    c = lambda n: F.col(f"{row}.{n}")
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options: float) -> list[Rule]:
    """Learn from at most ``most`` labelled documents that the base rules let through."""
    sample = labelled_sample(docs, labels, "quality", most).select("doc_id", "y", stats().alias("s"))
    found = sample.where(~base_failed("s")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if found.empty:
        return []
    s = found["s"].apply(lambda r: r.asDict() if hasattr(r, "asDict") else r)
    x = np.array([[r[n] / max(r[d], 1) for n, d in RATES.values()] for r in s], np.float64)
    return learn(x, (found["y"].to_numpy() == 0).astype(np.int64), **options)


def rejects(rules: list[Rule], row: str) -> Column:
    """The list as one conditional: the first rule that fits rejects, none keeps; the number of the
    rule (from 1), or 0."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        fits = F.lit(True)
        for c in rules[i - 1]:
            fits &= c.column(row)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts (struct ``s``), base_failed, rule, kept.

    Null, empty and wordless texts have counts of 0 and fail the base rules; repeated rows are
    judged alike; null ids pass through; an empty table gives no rows.
    """
    out = docs.select("doc_id", stats().alias("s"))
    out = out.withColumns({"base_failed": base_failed("s"), "rule": rejects(rules, "s")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep; no row is shuffled."""
    own = free_name(docs, "__s")
    marked = docs.withColumn(own, stats())
    return marked.where(~base_failed(own) & (rejects(rules, own) == 0)).drop(own)
