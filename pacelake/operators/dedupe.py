"""Keyed deduplication that never picks a silent winner.

Equal rows under a key collapse; different rows under a key are a conflict.
Rows are counted per distinct value first, so a hot key is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct rows over keys and fields with ``observation_count``."""
    return df.groupBy(*keys, *fields).agg(F.count("*").alias("observation_count"))


def canonical(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key that has a single value: the least and the greatest row of the key are equal. One shuffle, combined before it."""
    each = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("__lo"), F.max(F.struct(*fields)).alias("__hi"))
    return each.where(F.col("__lo").eqNullSafe(F.col("__hi"))).select(*keys, *[F.col("__lo")[c].alias(c) for c in fields])


def variants(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """All distinct rows of the keys that have several, with ``observation_count``."""
    each = observed(df, keys, fields)
    return each.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def fingerprint(fields: list[str]) -> Column:
    """The SHA-256 of a row's values as JSON with sorted names, nulls included: an identity of what was observed, wherever it was."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def traced_variants(df: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """Variants of divergent keys with ``variant_fingerprint`` and the snapshots (``order``) that hold each, none of which wins."""
    each = df.groupBy(*keys, *fields).agg(F.count("*").alias("observation_count"), F.array_join(F.array_sort(F.collect_set(order)).cast("array<string>"), ",").alias("snapshot_orders"))
    several = each.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")
    return several.withColumn("variant_fingerprint", fingerprint([*keys, *fields])).withColumn("canonical_status", F.lit("unresolved_multiple_observed_values"))


def audit(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row of counters: rows, keys, same-value duplicates, divergent keys and their variants, and a status."""
    per_key = observed(df, keys, fields).groupBy(*keys).agg(F.sum("observation_count").alias("rows"), F.count("*").alias("variants"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("source_record_count"),
        F.count("*").cast("long").alias("key_count"),
        F.coalesce(F.sum(F.col("rows") - F.col("variants")), F.lit(0)).cast("long").alias("same_value_duplicates"),
        F.coalesce(F.sum(F.when(F.col("variants") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("multi_variant_key_count"),
        F.coalesce(F.sum(F.when(F.col("variants") > 1, F.col("variants")).otherwise(0)), F.lit(0)).cast("long").alias("variant_count"),
    ).withColumn("status", F.when(F.col("multi_variant_key_count") > 0, "PASS_WITH_REVIEW_ITEMS").otherwise("PASS"))


def sound(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key; the job that reads it fails if a key has different rows."""
    each = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("__lo"), F.max(F.struct(*fields)).alias("__hi"))
    one = F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__lo")).otherwise(F.raise_error(F.lit(f"dedupe conflict: a key over {', '.join(keys)} has different rows")))
    return each.select(*keys, one.alias("__lo")).select(*keys, *[F.col("__lo")[c].alias(c) for c in fields])


def reviewed(df: DataFrame, keys: list[str], fields: list[str], provenance: list[str], review: dict[str, Column]) -> DataFrame:
    """One row for each key with ``review_required``. Where the rows of a key differ in ``provenance``, that is the row ``review`` instead of any of them,
    without a winner; where they differ in ``fields`` only, the job that reads it fails. Neither nulls nor repeats count as differences."""
    lo, hi = (f(F.struct(*fields)) for f in (F.min, F.max))
    from_lo, from_hi = (f(F.struct(*provenance)) for f in (F.min, F.max))
    each = df.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi"), (~from_lo.eqNullSafe(from_hi)).alias("review_required"))
    failed = F.raise_error(F.lit(f"dedupe conflict: a key over {', '.join(keys)} has different rows"))
    one = F.when(F.col("review_required"), F.struct(*[review[c].alias(c) if c in review else F.col("__lo")[c].alias(c) for c in fields])).when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__lo")).otherwise(failed)
    return each.select(*keys, one.alias("__lo"), "review_required").select(*keys, *[F.col("__lo")[c].alias(c) for c in fields], "review_required")


def finalize(df: DataFrame, keys: list[str], fields: list[str], preserve_variants: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical rows, variants and counters. Without ``preserve_variants`` a divergent key fails the job that reads the rows."""
    return (canonical if preserve_variants else sound)(df, keys, fields), variants(df, keys, fields), audit(df, keys, fields)


def agreed_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: the value if all valid ones agree, else null and a review status."""
    each = df.groupBy(*keys).agg(F.count("*").alias("record_count"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    differs = F.col("lo") != F.col("hi")
    return each.select(
        *keys,
        F.when(~differs, F.col("lo")).alias(value),
        "record_count",
        F.when(differs, "review_required_same_day_differing_values").when(F.col("lo").isNull(), "no_valid_value_for_date").when(F.col("record_count") > 1, "same_date_same_value_deduped").otherwise("single_value").alias("dedupe_status"),
    )


def review_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with ``needs_review``: whether its key occurs more than once."""
    return df.withColumn("needs_review", F.count("*").over(Window.partitionBy(*keys)) > 1)
