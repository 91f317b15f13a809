"""A quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled documents.  Every
path from a root is a conjunction of thresholds, that is, a rule.  A lasso
logistic regression gives each rule a weight, mostly zero, and the rules that
are left are compiled to one Spark column, so scoring is a projection of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted to, at most; the first by a hash of doc_id.
SAMPLE = 20_000


def _count(text: Column, what: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what.encode())).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules are made of; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    spaces = _count(t, " ") + 1
    lines = F.split(t, "\n")
    out = {
        "chars": F.length(t).cast("double"),
        "chars_per_word": n / spaces,
        "bytes_per_char": F.octet_length(t) / n,
        "lines_per_word": F.size(lines) / spaces,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_words": F.size(F.array_distinct(F.split(t, " "))) / spaces,
        "upper": (n - F.length(F.regexp_replace(t, "[A-Z]+", ""))) / n,
        "digits": (n - F.length(F.regexp_replace(t, "[0-9]+", ""))) / n,
    }
    for name, what in {"stops": ".", "commas": ",", "bangs": "!", "pipes": "|", "stars": "*", "hashes": "#", "dollars": "$", "percents": "%", "ats": "@", "slashes": "/"}.items():
        out[name] = _count(t, what) / spaces
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold) with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, within: str = "") -> Column:
        """The probability of label 1, over the columns of ``statistics``, or such fields of the column ``within``."""
        at = f"{within}." if within else ""
        total = F.lit(float(self.bias))
        for rule in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(at + s) > F.lit(v) if above else F.col(at + s) <= F.lit(v) for s, above, v in rule.terms])
            total = total + F.when(holds, F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2) -> list[tuple[tuple[str, bool, float], ...]]:
    """The paths of boosted regression trees, each grown on a half of the rows."""
    dice = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cell = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = _sigmoid(margin)
        grad, hess = y - p, p * (1 - p) + 1e-9
        used = np.flatnonzero(dice.random(len(y)) < 0.5)
        open_ = [((), np.arange(len(y)))]
        for level in range(depth + 1):
            nodes, open_ = open_, []
            for terms, rows in nodes:
                mine = rows[np.isin(rows, used, assume_unique=True)] if len(rows) < len(y) else used
                best = (1e-3, None, None)
                if level < depth and len(mine) >= 20:
                    g, h = grad[mine], hess[mine]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for j in range(x.shape[1]):
                        if len(cuts[j]):
                            gs = np.cumsum(np.bincount(cell[mine, j], g, len(cuts[j]) + 1))[:-1]
                            hs = np.cumsum(np.bincount(cell[mine, j], h, len(cuts[j]) + 1))[:-1]
                            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                            k = int(np.argmax(gain))
                            if gain[k] > best[0] + 1e-9:
                                best = (gain[k], j, k)
                if best[1] is None:
                    if len(mine):
                        margin[rows] += rate * grad[mine].sum() / (hess[mine].sum() + 1)
                    continue
                _, j, k = best
                under = cell[rows, j] <= k
                for above, part in ((False, rows[under]), (True, rows[~under])):
                    path = (*terms, (names[j], above, float(cuts[j][k])))
                    found[tuple(sorted(path))] = None
                    open_.append((path, part))
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = z.shape
    v = np.ones(m, dtype=np.float32)
    for _ in range(15):  # the largest eigenvalue gives the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (float(np.linalg.norm(z @ v)) ** 2 / n + 1) + 1e-9)
    w, bias, at, at_bias, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = _sigmoid(z @ at.astype(np.float32) + at_bias) - y
        new = at - step * (z.T @ r.astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias, grown = at_bias - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_bias = new + (t - 1) / grown * (new - w), new_bias + (t - 1) / grown * (new_bias - bias)
        w, bias, t = new, new_bias, grown
    return float(bias), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules from trees, weights by lasso. With labels of one kind only, or none, the model is a constant."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else (8.0 if y[0] else -8.0), ())
    paths = grow_rules(x, y, names)
    if not paths:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    at = {s: j for j, s in enumerate(names)}
    z = np.ones((len(y), len(paths)), dtype=np.float32)
    for k, path in enumerate(paths):
        for s, above, v in path:
            z[:, k] *= (x[:, at[s]] > v) == above
    bias, w = lasso(z, y)
    return RuleModel(bias, tuple(Rule(paths[k], float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-4)))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit the rules to at most ``sample`` labelled documents that are not held out.

    Labels need ``doc_id`` and ``quality``; null labels are left out.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), *[c.alias(s) for s, c in stats.items()])
    # of repeated rows of a document one counts, so that no more than the sample goes to the driver
    data = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id", kind="stable")
    return fit(data[names].to_numpy(dtype=np.float64), data["quality"].to_numpy(dtype=np.float64), names)


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts are scored by their statistics, all of which are then those of an
    empty text. Repeated rows give repeated results, columns other than doc_id and text are ignored.
    """
    stats = docs.select("doc_id", *[c.alias(s) for s, c in statistics(F.col("text")).items()])
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model scores 0.5 or more."""
    stats = F.struct(*[c.alias(s) for s, c in statistics(F.col("text")).items()])
    # a generator keeps the filter from being pushed below the statistics, which would work them out once per rule
    return docs.select("*", F.explode(F.array(stats)).alias("__statistics")).where(model.score("__statistics") >= 0.5).drop("__statistics")
