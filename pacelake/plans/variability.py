"""Heart-rate variability: daily candidates of binary files, references of health records, and whether both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelake.functions import coerce
from pacelake.operators import quality
from pacelake.plans import datasets, health

raw = datasets.raw


def daily_candidates(rows: DataFrame) -> DataFrame:
    """One row for each date of ``date, value, invalid, file``, and one, held back, for each row without a date.

    Values are never averaged: a date has a value only if all of its valid ones are equal.
    """
    valid = F.when(~F.col("invalid"), F.col("value"))
    each = rows.where("date is not null").groupBy("date").agg(
        F.min(valid).alias("lo"), F.max(valid).alias("hi"), F.count("*").alias("record_count_for_date"), F.count_distinct("file").alias("source_file_count_for_date"), F.sum(F.col("invalid").cast("long")).alias("invalid_raw_value_count_for_date")
    )
    some, bad = F.col("lo").isNotNull(), F.col("invalid_raw_value_count_for_date") > 0
    method = F.when(some & (F.col("lo") != F.col("hi")), "same_date_different_valid_values_not_averaged").when(some & bad, "same_date_valid_value_after_invalid_excluded").when(some, "same_date_same_value_deduped").when(bad, "only_invalid_raw_values_excluded").otherwise("no_valid_value_for_date")
    confidence = F.when(some, "needs_inspection").when(bad, "invalid_raw_value").otherwise("raw_required_hold")
    out = each.select("date", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("value"), "record_count_for_date", "source_file_count_for_date", "invalid_raw_value_count_for_date", confidence.alias("confidence_status"), method.alias("dedupe_method"))
    one = F.lit(1).cast("long")
    held = rows.where("date is null").select("date", "value", one, one, F.col("invalid").cast("long"), F.lit("raw_required_hold"), F.lit("missing_date_raw_required_hold"))
    return out.union(held)


def references(assets: DataFrame) -> DataFrame:
    """One row for each health record, with the last of its metrics of this kind; all records of a date that has several need review."""
    rows = health.source_rows(assets, "healthStatusData.json", "health")
    listed = F.transform(F.from_json(F.when(raw("metrics").startswith("["), raw("metrics")), "array<variant>"), lambda v: F.to_json(v))
    mine = F.filter(listed, lambda j: j.startswith("{") & (F.lower(coerce.any_text(coerce.field(j, "type"))) == "hrv"))
    last = F.try_element_at(mine, F.lit(-1))
    out = rows.select(datasets._day(("calendarDate", "date")).alias("date"), last.isNotNull().alias("present"), coerce.number(coerce.field(last, "value")).alias("value"), "record_index")
    reason = quality.first_reason([(F.col("date").isNull(), "health_status_hrv_missing_calendar_date"), (F.col("several"), "health_status_hrv_duplicate_calendar_date"), (~F.col("present"), "health_status_hrv_metric_not_present"), (F.col("value").isNull(), "health_status_hrv_value_invalid_or_missing")])
    out = out.withColumn("several", F.col("date").isNotNull() & (F.count("*").over(Window.partitionBy("date")) > 1)).withColumn("reference_reason_code", F.coalesce(reason, F.lit("health_status_hrv_reference_available")))
    status = F.when(F.col("reference_reason_code") == "health_status_hrv_reference_available", "reference_available").when(F.col("reference_reason_code") == "health_status_hrv_metric_not_present", "reference_missing").otherwise("needs_review")
    return out.select("date", "value", status.alias("reference_status"), "reference_reason_code", "record_index")


def consistency(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """Per date: both values and one of six statuses; equal is within 1e-9."""
    a = candidates.where("date is not null").select("date", F.col("value").alias("fit_hrv_value"), F.lit(True).alias("has"))
    b = reference.where("date is not null").groupBy("date").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    both = a.join(b, "date", "full").withColumn("health_status_hrv_value", F.when(F.col("n") == 1, F.col("v")))
    x, y = F.col("fit_hrv_value"), F.col("health_status_hrv_value")
    status = (
        F.when(F.col("n") > 1, "needs_review_duplicate_health_status_date").when(F.col("has").isNull(), "health_status_only").when(F.col("n").isNull(), "fit_only")
        .when(x.isNull() | y.isNull(), "needs_review_missing_value").when(F.abs(x - y) <= 1e-9, "same_date_value_match").otherwise("same_date_value_difference")
    )
    return both.select("date", "fit_hrv_value", "health_status_hrv_value", status.alias("consistency_status"))
