"""Evidence-qualified matching: a banded time join, scores, and mutual unique best pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_us: str, right_us: str, width_us: int, on: list[str] | None = None) -> DataFrame:
    """Pairs whose times, in microseconds, differ by at most ``width_us`` (and that agree in ``on``).

    Times are filed in bands of the width; the right side is filed in its own and both next ones, so an equi-join finds every pair once.
    """
    on = on or []
    a = left.withColumn("__band", F.expr(f"{left_us} div {width_us}"))
    b = right.withColumn("__band", F.explode(F.expr(f"array({right_us} div {width_us} - 1, {right_us} div {width_us}, {right_us} div {width_us} + 1)")))
    return a.join(b, ["__band", *on]).where(F.abs(F.col(left_us) - F.col(right_us)) <= width_us).drop("__band")


def ranked(candidates: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """Candidates with ``left_top, right_top``, whether they have the best score of a side, and ``left_tied, right_tied``, how many of that side have.

    The candidates are computed once and shuffled once for each side.
    """
    out = candidates
    for side, name in ((left, "left"), (right, "right")):
        w = Window.partitionBy(side)
        out = out.withColumn(f"{name}_top", F.col(score) == F.max(score).over(w)).withColumn(f"{name}_tied", F.sum(F.col(f"{name}_top").cast("long")).over(w))
    return out


def _linked() -> Column:
    return F.col("left_top") & F.col("right_top") & (F.col("left_tied") == 1) & (F.col("right_tied") == 1)


def mutual_best(candidates: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """Pairs that are the only best of both sides. A tie for the best makes a side ambiguous; no second round is held."""
    return ranked(candidates, left, right, score).where(_linked()).select(candidates.columns)


def residuals(side: DataFrame, key: str, eligible: Column, found: DataFrame, name: str) -> DataFrame:
    """``key, outcome`` of every row: linked, excluded, no_evidence_qualified_candidate, ambiguous_candidate or one_to_one_conflict.

    ``found`` are candidates as ``ranked`` gives them, ``name`` is the side (left or right) that ``key`` is of.
    """
    each = found.groupBy(key).agg(F.bool_or(_linked()).alias("__linked"), F.max(f"{name}_tied").alias("__n"))
    out = side.withColumn("__eligible", eligible).join(each, key, "left")
    outcome = F.when(F.col("__linked"), "linked").when(~F.col("__eligible"), "excluded").when(F.col("__n").isNull(), "no_evidence_qualified_candidate").when(F.col("__n") > 1, "ambiguous_candidate").otherwise("one_to_one_conflict")
    return out.select(key, outcome.alias("outcome"))


def evidence_score(dt_sec: Column, sport_equal: Column, d_distance: Column, d_duration: Column) -> tuple[Column, Column]:
    """Score and rule of a candidate pair, null where neither rule holds.

    Rule A: equal starts and at least one of sport, distance within 200 m, duration within 5 s. Rule B: starts within 60 s,
    equal sport, distance within 1 m and duration within 1 s.
    """
    sport = F.coalesce(sport_equal, F.lit(False))
    near, close = F.coalesce(d_distance <= 200, F.lit(False)), F.coalesce(d_duration <= 5, F.lit(False))
    n = sport.cast("int") + near.cast("int") + close.cast("int")
    a = (dt_sec == 0) & (n > 0)
    b = (dt_sec <= 60) & sport & F.coalesce(d_distance <= 1, F.lit(False)) & F.coalesce(d_duration <= 1, F.lit(False))
    score = F.when(a, 1000 + 100 * n).when(b, 800 + F.floor(60 - dt_sec))
    return score.cast("long"), F.when(a, "exact_start_with_corroboration").when(b, "near_start_exact_metrics")
