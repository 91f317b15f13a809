"""Activity trends: periods, rates, gaps and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_totals(df: DataFrame, period: Column, amount: str, optional: str) -> DataFrame:
    """Per period: rows, total amount, and rows with and without the optional value."""
    return df.groupBy(period.alias("period")).agg(F.count("*").cast("long").alias("activity_count"), F.round(F.sum(amount), 2).alias("total_amount"), F.count(optional).cast("long").alias("observed_count"), F.sum(F.when(F.col(optional).isNull(), 1).otherwise(0)).cast("long").alias("missing_count"))


def gaps(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Per key: dates, and the largest and mean number of days between one and the next."""
    days = df.select(*keys, F.col(date).cast("date").alias("d")).distinct()
    each = days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(*keys).orderBy("d"))))
    return each.groupBy(*keys).agg(F.count("*").cast("long").alias("date_count"), F.max("gap").cast("long").alias("max_gap_days"), F.round(F.avg("gap"), 4).alias("mean_gap_days"))


def first_last(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Per key: the means of the first and of the last n values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sorted like w, so rows are sorted once
    each = df.withColumn("i", F.row_number().over(w)).withColumn("j", F.count("*").over(whole) - F.col("i") + 1)
    return each.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("i") <= n, F.col(value))), 4).alias("first_mean"), F.round(F.avg(F.when(F.col("j") <= n, F.col(value))), 4).alias("last_mean"))


def full_outer(left: DataFrame, right: DataFrame, on: str, left_prefix: str, right_prefix: str) -> DataFrame:
    """Full outer join with the other columns prefixed by their side."""
    a = left.select(on, *[F.col(c).alias(left_prefix + c) for c in left.columns if c != on])
    b = right.select(on, *[F.col(c).alias(right_prefix + c) for c in right.columns if c != on])
    return a.join(b, on, "full")
