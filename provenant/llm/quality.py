"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees are fitted to a bounded sample of labelled rows; every path from
a root to a node is a conjunctive rule; lasso logistic regression weighs the
rules and drops most; what is left is compiled into Spark column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import word_count


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, from built-in functions; null counts as empty. No other column is used."""
    text = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "words": word_count(text).cast("double"),
        "not_upper": left(r"\p{Lu}+"),
        "not_digit": left(r"\p{Nd}+"),
        "not_letter": left(r"[\p{L}\p{M}]+"),
        "marks": F.length(F.regexp_replace(text, r"[^!?#$%&*|<>{}=@~^_+\\/\[\]]+", "")).cast("double"),
        "stops": F.length(F.regexp_replace(text, r"[^.]+", "")).cast("double"),
        "commas": F.length(F.regexp_replace(text, r"[^,]+", "")).cast("double"),
        "lines": F.size(F.split(text, "\n")).cast("double"),
        "distinct_lines": F.size(F.array_distinct(F.split(text, "\n"))).cast("double"),
        "distinct_words": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).cast("double"),
    }


def features(s: dict[str, Column]) -> dict[str, Column]:
    """Ratios of those statistics; an empty text has zeros, and one line, which is distinct."""
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    letters = s["chars"] - s["not_letter"]
    return {
        "chars": s["chars"],
        "words": s["words"],
        "word_length": ratio(letters, s["words"]),
        "upper": ratio(s["chars"] - s["not_upper"], letters),
        "digits": ratio(s["chars"] - s["not_digit"], s["chars"]),
        "letters": ratio(letters, s["chars"]),
        "marks": ratio(s["marks"], s["words"]),
        "stops": ratio(s["stops"], s["words"]),
        "commas": ratio(s["commas"], s["words"]),
        "line_words": ratio(s["words"], s["lines"]),
        "distinct_lines": ratio(s["distinct_lines"], s["lines"]),
        "distinct_words": ratio(s["distinct_words"], s["words"]),
        "stops_per_line": ratio(s["stops"], s["lines"]),
    }


FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "letters", "marks", "stops", "commas",
    "line_words", "distinct_lines", "distinct_words", "stops_per_line",
)


def with_features(rows: DataFrame, mark: str = "__q_") -> DataFrame:
    """rows with a struct column `mark` of the features of their text.

    The row number keeps the optimizer from copying the costly statistics into
    every use of them: it moves no filter below a step that is not deterministic.
    """
    stat = statistics(F.col("text"))
    rows = rows.withColumn(mark + "s", F.struct(*[c.alias(k) for k, c in stat.items()])).withColumn(mark + "n", F.monotonically_increasing_id())
    ratios = features({k: F.col(f"{mark}s.{k}") for k in stat})
    return rows.where(F.col(mark + "n") >= 0).withColumn(mark, F.struct(*[c.alias(k) for k, c in ratios.items()])).drop(mark + "s", mark + "n")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above?, threshold) and its weight."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for feature, above, at in self.tests:
            out &= (x[:, feature] > at) == above
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule in self.rules:
            z += rule.weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, mark: str = "__q_") -> Column:
        """The score as a Spark expression over the features struct."""
        z = F.lit(self.bias)
        for rule in self.rules:
            test = None
            for feature, above, at in rule.tests:
                value = F.col(f"{mark}.{FEATURES[feature]}")
                one = value > F.lit(at) if above else value <= F.lit(at)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x, bins, edges, grad, hess, depth, least):
    """One regression tree on binned features: the (tests, leaf value, members) of every node but the root."""
    nodes, work = [], [((), np.arange(len(grad)), 0)]
    step = np.zeros(len(grad))
    while work:
        tests, rows, level = work.pop()
        g, h = grad[rows], hess[rows]
        if tests:
            nodes.append(tests)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            base = g.sum() ** 2 / (h.sum() + 1)
            for f in range(bins.shape[1]):
                size = len(edges[f]) + 1
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            step[rows] = g.sum() / (h.sum() + 1)
            continue
        f, k = best[1]
        low = bins[rows, f] <= k
        at = float(edges[f][k])
        work.append((tests + ((f, False, at),), rows[low], level + 1))
        work.append((tests + ((f, True, at),), rows[~low], level + 1))
    return nodes, step


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, l1: float = 2e-3, rate: float = 0.3) -> RuleModel:
    """Fit trees, take their paths as rules, and weigh them by lasso logistic regression (accelerated proximal steps).

    No rows, or rows of one class only, give a constant score: 0.5, or the
    smoothed share of that class.
    """
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    bias = math.log(prior / (1 - prior))
    if n == 0 or y.min() == y.max():
        return RuleModel(bias, ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64), method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, paths = np.full(n, bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        nodes, step = _tree(x, bins, edges, y - p, p * (1 - p), depth, max(5, n // 1000))
        z += rate * step
        paths |= dict.fromkeys(tuple(sorted(t)) for t in nodes)
    rules = [Rule(t, 0.0) for t in paths]
    if not rules:
        return RuleModel(bias, ())
    m = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    mean = m.mean(axis=0)
    centred = m - mean
    top = np.linalg.norm(centred.T @ centred / n, 2) / 4 + 0.25
    w, b, v, c, t = np.zeros(len(rules)), bias, np.zeros(len(rules)), bias, 1.0
    for _ in range(800):
        r = 1 / (1 + np.exp(-(centred @ v + c))) - y
        new = v - centred.T @ r / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / top, 0)
        nb = c - r.mean() / top
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        moved, w, b, t = np.abs(new - w).max(), new, nb, t2
        if moved < 1e-6:
            break
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    return RuleModel(float(b - mean @ w), tuple(Rule(rules[k].tests, float(w[k])) for k in kept))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> RuleModel:
    """Fit on at most about sample_rows labelled documents, drawn by a hash of their ids, none of them held out.

    Several labels of one id count by their mean; a tie or null is no label.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    voted = usable.groupBy("doc_id").agg(F.avg("quality").alias("y")).where("y <> 0.5")
    count = voted.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = voted.where(draw < int(min(1.0, sample_rows / max(count, 1)) * 1_000_000)).select(F.col("doc_id").alias("__q_id"), (F.col("y") > 0.5).cast("int").alias("__q_y"))
    # bounded by sample_rows, whatever the corpus holds
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__q_id"))
    got = with_features(rows).select("doc_id", "__q_y", "__q_.*").orderBy("doc_id", "chars").toPandas()
    return fit_rules(got[list(FEATURES)].to_numpy(dtype=np.float64), got["__q_y"].to_numpy(dtype=np.float64))


def op10_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents(doc_id, text).

    The score follows from the whole text alone; empty and null texts have
    one. Repeated rows are scored alike. Without usable labels every score
    is 0.5. Extra columns are ignored; an empty table gives an empty result.
    """
    model = train(documents, labels, sample_rows)
    scored = with_features(documents.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, at_least: float = 0.5) -> DataFrame:
    """The rows of documents whose score is at_least or more, columns unchanged."""
    model = train(documents, labels, sample_rows)
    names = documents.columns
    return with_features(documents).where(model.column() >= at_least).select(*[F.col(f"`{n}`") for n in names])
