"""Presence of keys across any number of snapshots, as strings of 0 and 1; everything but the patterns works on their histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logical_order(snapshots: DataFrame, by: list[str]) -> DataFrame:
    """Snapshots numbered 1.. in acquisition order; ``snapshots`` has one row each."""
    from pyspark.sql import Window

    return snapshots.withColumn("logical_order", F.row_number().over(Window.orderBy(*by)).cast("long"))


def pattern(orders: str, snapshots: int):
    """A 1 at each of the ``orders`` (an array) and 0 elsewhere, ``snapshots`` characters; an order outside of 1..snapshots is an error."""
    joined = f"rpad(aggregate(array_sort({orders}), '', (made, at) -> concat(made, repeat('0', CAST(at AS INT) - length(made) - 1), '1')), {snapshots}, '0')"
    outside = f"exists({orders}, at -> at < 1 OR at > {snapshots})"
    return F.expr(f"CASE WHEN {outside} THEN raise_error('a snapshot is not one of the {snapshots} there are') ELSE {joined} END").alias("presence_pattern")


def presence(observations: DataFrame, keys: list[str], order: str, snapshots: int) -> DataFrame:
    """``keys, presence_pattern, snapshot_count, observation_count`` of every key."""
    each = observations.groupBy(*keys).agg(F.collect_set(order).alias("orders"), F.count("*").cast("long").alias("observation_count"))
    return each.select(*keys, pattern("orders", snapshots), F.size("orders").cast("long").alias("snapshot_count"), "observation_count")


def flags(patterns: DataFrame) -> DataFrame:
    """Adds whether a key is new, only in earlier snapshots, or has come back after a gap."""
    p = F.col("presence_pattern")
    return patterns.withColumns({"is_new": p.rlike("^0*1$"), "is_previous_only": p.endswith("0"), "is_reappeared": p.rlike("10+1")})


def histogram(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("presence_pattern").agg(F.count("*").cast("long").alias("key_count"))


def _at(order: str) -> str:
    return f"substr(presence_pattern, {order}, 1) = '1'"


def prefixes(patterns: DataFrame, snapshots: int) -> DataFrame:
    """Keys first seen in each snapshot, and seen up to it."""
    each = histogram(patterns).withColumn("first", F.instr("presence_pattern", "1")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(snapshots))))
    return each.groupBy(F.col("n").cast("long").alias("logical_order")).agg(F.sum(F.expr("CASE WHEN first = n THEN key_count ELSE 0 END")).cast("long").alias("new_keys"), F.sum(F.expr("CASE WHEN first BETWEEN 1 AND n THEN key_count ELSE 0 END")).cast("long").alias("cumulative_keys"))


def pairwise(patterns: DataFrame, snapshots: int) -> DataFrame:
    """Keys on either and on both sides, for every pair of snapshots."""
    n = F.sequence(F.lit(1), F.lit(snapshots))
    each = histogram(patterns).withColumn("l", F.explode(n)).withColumn("r", F.explode(n)).where("l < r")
    left, right = _at("l"), _at("r")

    def count(what: str, name: str):
        return F.sum(F.expr(f"CASE WHEN {what} THEN key_count ELSE 0 END")).cast("long").alias(name)

    return each.groupBy(F.col("l").cast("long").alias("left_order"), F.col("r").cast("long").alias("right_order")).agg(
        count(left, "left_count"), count(right, "right_count"), count(f"{left} AND {right}", "overlap_count"), count(f"{left} AND NOT {right}", "left_only_count"), count(f"NOT {left} AND {right}", "right_only_count")
    )


def leave_one_out(patterns: DataFrame, snapshots: int) -> DataFrame:
    """Keys that only this snapshot has, for every snapshot."""
    each = histogram(patterns).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(snapshots))))
    alone = f"{_at('n')} AND length(replace(presence_pattern, '0', '')) = 1"
    return each.groupBy(F.col("n").cast("long").alias("logical_order")).agg(F.sum(F.expr(f"CASE WHEN {alone} THEN key_count ELSE 0 END")).cast("long").alias("unique_keys"))
