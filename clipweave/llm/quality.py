"""Quality classifier: a sparse ensemble of rules over text statistics.

Small regression trees are boosted on a bounded sample of labelled rows; every path from a root is a conjunction of
thresholds, a rule. A lasso logistic fit keeps a few rules, and these are compiled into one Spark column expression, so scoring is a
projection. The statistics are Spark columns as well, over whole texts.

Defined results: a null text counts as empty and is scored like any other. A document with several labels takes their mean, rounded; null labels
don't count. Without labels, or with one class, the score is the smoothed share of label 1. Repeated rows repeat; an empty table gives an
empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.shared import WHITE, let, materialize

#: Labelled rows that a fit draws at most, in expectation, by a hash of the id.
FIT_ROWS = 5_000
UPPER, DIGITS, SYMBOLS, STOPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*<>{}[]=_~^@\\/+", ".,;:"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all finite; ratios are per character or per word."""
    n = F.length(text)
    of = lambda chars: (n - F.length(F.translate(text, chars, ""))).cast("double") / F.greatest(n, F.lit(1))
    words = F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    kinds = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "length": n.cast("double"),
        "words": kinds,
        "upper": of(UPPER),
        "digits": of(DIGITS),
        "symbols": of(SYMBOLS),
        "stops": of(STOPS),
        "bangs": of("!"),
        "bars": of("|"),
        "lines": of("\n"),
        "white": of(WHITE),
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id and one column per statistic; ``with_row``: the whole row as well, as the struct row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct("*").alias("row")] if with_row else []
    s = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in statistics(text).items()], *row)
    n = F.greatest(F.col("words.n"), F.lit(1))
    return s.select(
        "doc_id", "length", F.col("words.n").cast("double").alias("n_words"), (F.col("words.distinct") / n).alias("distinct"), (F.col("length") * (1 - F.col("white")) / n).alias("word_length"),
        "upper", "digits", "symbols", "stops", "bangs", "bars", "lines", "white", *(["row"] if with_row else []),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above or not, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > t if above else F.col(f) <= t for f, above, t in self.tests])

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.logical_and.reduce([(x[:, names.index(f)] > t) == above for f, above, t in self.tests])


@dataclass
class RuleEnsemble:
    """Weighted rules and an intercept of a logistic score."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        logit = F.lit(self.intercept)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))

    def scores(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        logit = self.intercept + sum((w * r.holds(x, names) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-logit))


def _tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], cols: np.ndarray, depth: int, least: int) -> list[tuple[tuple, np.ndarray, float]]:
    """Nodes (tests, rows, mean) of a regression tree, its root aside, grown greedily by squared error."""
    nodes: list[tuple[tuple, np.ndarray, float]] = []
    todo = [((), np.arange(len(x)), depth)]
    while todo:
        tests, rows, left = todo.pop()
        if tests:
            nodes.append((tests, rows, float(target[rows].mean())))
        if not left or len(rows) < 2 * least:
            continue
        y, best = target[rows], (1e-9, None)
        for c in cols:
            if not len(cuts[c]):
                continue
            at = np.searchsorted(cuts[c], x[rows, c], "left")  # x <= cut k exactly where at <= k
            n = np.cumsum(np.bincount(at, minlength=len(cuts[c]) + 1))[:-1]
            s = np.cumsum(np.bincount(at, y, len(cuts[c]) + 1))[:-1]
            fine = (n >= least) & (len(rows) - n >= least)
            gain = np.where(fine, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - y.sum() ** 2 / len(rows), -1.0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (int(c), float(cuts[c][k])))
        if best[1]:
            c, t = best[1]
            above = x[rows, c] > t
            todo += [((*tests, (c, True, t)), rows[above], left - 1), ((*tests, (c, False, t)), rows[~above], left - 1)]
    return nodes


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights of 0/1 columns under an L1 penalty, by accelerated proximal steps; the intercept is free."""
    a = np.hstack([np.ones((len(r), 1), r.dtype), r])
    w = np.zeros(a.shape[1], r.dtype)
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    z, t = w.copy(), 1.0
    v = np.ones(a.shape[1], r.dtype)
    for _ in range(20):  # the largest eigenvalue gives the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / len(y) + 1e-12)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003), seed: int = 11) -> RuleEnsemble:
    """An ensemble for rows ``x`` with labels ``y`` (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = RuleEnsemble(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return base
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 48))) for c in range(x.shape[1])]
    logit = np.full(len(y), base.intercept)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        rows = rng.permutation(len(y))[: max(20, len(y) // 2)]
        cols = rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]
        for tests, _, mean in _tree(x[rows], residual[rows], cuts, cols, depth, max(3, len(rows) // 200)):
            rule = Rule(tuple(sorted((names[c], above, t) for c, above, t in tests)))
            rules.setdefault(rule)
            if len(tests) == depth:
                logit = logit + 1.5 * mean * rule.holds(x, names)
    every = list(rules)
    r = np.stack([q.holds(x, names) for q in every], 1).astype(np.float32)
    held = rng.random(len(y)) < 0.25
    loss = []
    for penalty in penalties:
        b, w = _lasso(r[~held], y[~held], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + r[held] @ w))), 1e-6, 1 - 1e-6)
        loss.append(-np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)) if held.any() else 0.0)
    # The strongest penalty that is nearly as good as the best, for few rules.
    fine = next(p for p, x in zip(penalties, loss, strict=True) if x <= 1.1 * min(loss) + 0.005)
    b, w = _lasso(r, y, fine)
    return RuleEnsemble(b, [(q, float(v)) for q, v in zip(every, w, strict=True) if abs(v) > 1e-6])


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label_col: str = "quality", id_col: str = "doc_id") -> RuleEnsemble:
    """Fits on rows of ``stats`` that ``labels`` marks; about ``fit_rows`` of them, chosen by a hash of the id, reach the driver."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    n = marks.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(1, n)))
    names = [c for c in stats.columns if c != "doc_id"]
    sample = stats.join(marks.where(draw), "doc_id").toPandas().sort_values(["doc_id", *names])
    return fit(sample[names].to_numpy(np.float64), sample["label"].to_numpy(np.float64), names)


def score(stats: DataFrame, ensemble: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold`` on)."""
    return stats.select("doc_id", ensemble.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that an ensemble trained on ``labels`` rejects, row by row, also where an id is null or repeated."""
    stats = materialize(features(docs, id_col, text_col, with_row=True), "quality_stats")
    return stats.where(train(stats.drop("row"), labels).score() >= threshold).select("row.*")
