"""Datasets that are not part of the seventeen: health status, record-level sleep and checks of threshold candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.functions import coerce, times
from pacelake.operators import quality, snapshot
from pacelake.plans import datasets
from pacelake.sources import wrappers

raw = datasets.raw

# Types of metrics that have columns of their own, the columns' ends and the source fields.
METRIC_TYPES = ["HRV", "HR", "SPO2", "SKIN_TEMP_C", "RESPIRATION"]
METRIC_FIELDS = {"value": "value", "status": "status", "baseline_upper": "baseline_upper_limit", "baseline_lower": "baseline_lower_limit", "percentage": "percentage", "feedback_key": "feedback_key"}


def source_rows(assets: DataFrame, suffix: str, kind: str) -> DataFrame:
    """Source rows as they are, or read from the files with this suffix."""
    return assets if "record" in assets.columns else wrappers.suffix_rows(assets, suffix, kind)


def _instant(json: Column) -> Column:
    return times.observation_timestamp(coerce.any_text(json), coerce.is_number(json), named_utc=True, utc="+00:00")[0]


def _trimmed(json: Column) -> Column:
    text = F.trim(coerce.text(json))
    return F.when(text != "", text)


def _given(json: Column) -> Column:
    """Whether a field is there with something in it."""
    return F.coalesce(~json.isin("null", '""'), F.lit(False))


def health_status(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily table, one row for each date and one for each record without, and the table of all metrics with what became of their records.

    Of the records of a date the last by update, creation and key is taken; this is decided before metrics are exploded, so nothing is joined.
    """
    rows = source_rows(assets, "healthStatusData.json", "health")
    by_date = Window.partitionBy("calendar_date")
    latest = by_date.orderBy(*[F.desc(F.coalesce(c, F.lit(""))) for c in ("update_timestamp_utc", "create_timestamp_utc", "health_status_daily_record_key")])
    dated = F.col("calendar_date").isNotNull()
    listed = F.from_json(F.when(raw("metrics").startswith("["), raw("metrics")), "array<variant>")
    records = rows.select(
        F.concat(F.lit("health_status_daily:"), F.substring("sha256", 1, 24), F.lit(":"), F.col("record_index")).alias("health_status_daily_record_key"),
        datasets._day(("calendarDate", "date")).alias("calendar_date"), _instant(raw("createTimestampUTC")).alias("create_timestamp_utc"), _instant(raw("updateTimestampUTC")).alias("update_timestamp_utc"), coerce.number(raw("outliersCount")).alias("outliers_count"),
        F.filter(F.transform(listed, lambda v: F.to_json(v)), lambda j: j.startswith("{")).alias("metrics"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"),
    )
    records = records.withColumn("same_date", F.when(dated, F.count("*").over(by_date)).otherwise(1)).withColumn("rank", F.when(dated, F.row_number().over(latest)))
    choice = F.when(~dated, "missing_date_hold").when(F.col("rank") == 1, "selected_for_daily").otherwise("superseded_for_daily")
    base = ["health_status_daily_record_key", "calendar_date", "create_timestamp_utc", "update_timestamp_utc", "outliers_count", "source_path", "source_sha256"]
    each = records.select(*base, "same_date", choice.alias("daily_selection_status"), F.posexplode_outer("metrics").alias("metric_index", "metric"))
    f = lambda name: coerce.field(F.col("metric"), name)
    metrics = each.withColumns({"metric_type": F.upper(_trimmed(f("type"))), "value": coerce.number(f("value"), bounded="all"), "baseline_upper_limit": coerce.number(f("baselineUpperLimit"), bounded="all"), "baseline_lower_limit": coerce.number(f("baselineLowerLimit"), bounded="all"), "percentage": coerce.number(f("percentage"), bounded="all"), "status": _trimmed(f("status")), "feedback_key": _trimmed(f("feedbackKey"))})
    context = [_given(f(s)) & F.col(t).isNull() for s, t in (("baselineUpperLimit", "baseline_upper_limit"), ("baselineLowerLimit", "baseline_lower_limit"), ("percentage", "percentage"))]
    reason = quality.first_reason([(~dated, "health_status_missing_calendar_date"), (F.col("metric_type").isNull(), "health_status_missing_metric_type"), (_given(f("value")) & F.col("value").isNull(), "health_status_metric_value_invalid"), (context[0] | context[1] | context[2], "health_status_metric_context_invalid")])
    metrics = metrics.withColumn("metric_reason_code", F.when(F.col("metric").isNotNull(), F.coalesce(reason, F.lit("health_status_metric_available"))))
    metrics = metrics.withColumn("metric_normalization_status", F.when(F.col("metric_reason_code") == "health_status_metric_available", "available").otherwise("needs_review"))

    mine = {t: F.col("metric_type") == t for t in METRIC_TYPES}
    wide = [F.when(F.count(F.when(is_it, 1)) == 1, F.max(F.when(is_it, F.col(source)))).alias(f"health_status_{t.lower()}_{end}") for t, is_it in mine.items() for end, source in METRIC_FIELDS.items()]
    twice = [F.count(F.when(is_it, 1)) > 1 for is_it in mine.values()]
    one = metrics.where("daily_selection_status <> 'superseded_for_daily'").groupBy(*base, "same_date").agg(
        F.count("metric").alias("source_metric_count"), F.count(F.when(F.col("metric").isNotNull() & ~F.coalesce(F.col("metric_type").isin(METRIC_TYPES), F.lit(False)), 1)).alias("unknown_metric_count"),
        (twice[0] | twice[1] | twice[2] | twice[3] | twice[4]).alias("twice"), F.coalesce(F.bool_or(F.when(F.col("metric").isNotNull(), F.col("metric_normalization_status") == "needs_review")), F.lit(False)).alias("review"), *wide,
    )
    found = quality.first_reason([(~dated, "health_status_missing_calendar_date"), (F.col("source_metric_count") == 0, "health_status_no_metrics"), (F.col("twice"), "health_status_duplicate_metric_type"), (F.col("review"), "health_status_metric_requires_review")])
    several = F.col("same_date") > 1
    daily = one.withColumns({
        "daily_duplicate_count_before_dedupe": F.col("same_date").cast("long"), "daily_dedupe_method": F.when(several, "latest_update_then_create_then_stable_key").otherwise("not_needed_unique_calendar_date"),
        "health_status_normalization_status": F.when(found.isNotNull(), "needs_review").when(several, "available_with_explicit_dedupe").otherwise("available"),
        "health_status_reason_code": F.coalesce(found, F.when(several, "health_status_duplicate_calendar_date_resolved").otherwise("health_status_daily_available")),
    }).drop("same_date", "twice", "review")
    key = F.concat("health_status_daily_record_key", F.lit(":metric:"), F.col("metric_index")).alias("health_status_metric_record_key")
    return daily, metrics.where("metric is not null").select(key, "*").drop("metric", "metric_index", "same_date")


def sleep_records(assets: DataFrame) -> DataFrame:
    """Every sleep record with its status; all of a day with several are marked for review, records without content don't count."""
    rows = source_rows(assets, "sleepData.json", "sleep")
    start, end = (_instant(raw(n)).try_cast("timestamp") for n in ("sleepStartTimestampGMT", "sleepEndTimestampGMT"))
    local = lambda t: times.local_iso(F.unix_millis(t))
    score = F.coalesce(coerce.number(coerce.field(raw("sleepScores"), "overall", "value")), coerce.number(coerce.field(raw("sleepScores"), "overallScore")), coerce.number(raw("overallScore")), coerce.number(raw("sleepScore")))
    window = (F.unix_micros(end) - F.unix_micros(start)) / 60e6
    source = datasets._day(("calendarDate",))
    empty = source.isNull() & start.isNull() & end.isNull() & score.isNull() & (F.map_contains_key("record", F.lit("retro")) | (F.size("record") == 1))
    reason = quality.first_reason([(empty, "sleep_json_empty_retro_only_record"), (end.isNull(), "sleep_json_missing_sleep_end_date_jst"), (start.isNull(), "sleep_json_missing_start_or_end"), (~F.coalesce(window > 0, F.lit(False)), "sleep_json_invalid_sleep_interval")])
    out = rows.select(
        F.concat(F.lit("sleep_record:"), F.substring("sha256", 1, 24), F.lit(":"), F.col("record_index")).alias("sleep_record_key"), times.local_day(F.unix_millis(end)).alias("sleep_day"), source.alias("sleep_calendar_date_source"), local(start).alias("sleep_start_local"), local(end).alias("sleep_end_local"),
        window.alias("sleep_window_minutes_including_awake"), score.alias("sleep_score"), F.coalesce(reason, F.lit("sleep_json_daily_available")).alias("sleep_reason_code"), F.col("record_index").alias("source_record_index"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"),
    )
    counts = F.col("sleep_day").isNotNull() & (F.col("sleep_reason_code") != "sleep_json_empty_retro_only_record")
    several = counts & (F.sum(counts.cast("int")).over(Window.partitionBy("sleep_day")) > 1)
    out = out.withColumn("sleep_reason_code", F.when(several, "sleep_json_duplicate_sleep_day").otherwise(F.col("sleep_reason_code")))
    fine, hollow = F.col("sleep_reason_code") == "sleep_json_daily_available", F.col("sleep_reason_code") == "sleep_json_empty_retro_only_record"
    return out.withColumns({"sleep_normalization_status": F.when(fine, "available").when(hollow, "excluded_empty_record").otherwise("needs_review"), "sleep_limitation_type": F.when(fine, "none").when(hollow, "empty_record").otherwise("data_quality_limitation"), "sleep_source_available_for_analysis_flag": fine})


# Numeric fields of threshold candidates.
THRESHOLDS = ["lactateThresholdSpeed", "lactateThresholdHeartRate", "functionalThresholdPower"]


def threshold_counts(candidates: DataFrame) -> DataFrame:
    """Per family: observations, different ones, and those of which a numeric field holds something else. Equal observations are one candidate."""
    bad = quality.first_reason([(_present(F.col("record")[name]), name) for name in THRESHOLDS])
    each = candidates.select(F.col("observation_family").cast("string").alias("observation_family"), "observation_timestamp", snapshot.signature("record").alias("signature"), bad.isNotNull().alias("invalid"))
    distinct = each.groupBy("observation_family", "observation_timestamp", "signature").agg(F.count("*").alias("n"), F.bool_or("invalid").alias("invalid"))
    return distinct.groupBy("observation_family").agg(F.sum("n").alias("observation_count"), F.count("*").alias("candidate_count"), F.sum(F.when(F.col("invalid"), F.col("n")).otherwise(0)).alias("invalid_field_count"))


def power_conflicts(candidates: DataFrame) -> DataFrame:
    """Families and times under which different powers were observed, none of which is promoted."""
    power = F.col("record")["functionalThresholdPower"]
    each = candidates.where(power.isNotNull() & (power != "null")).groupBy(F.col("observation_family").cast("string").alias("observation_family"), "observation_timestamp").agg(F.count_distinct(power).alias("candidate_count"))
    return each.where("candidate_count > 1")


def malformed_thresholds(candidates: DataFrame) -> DataFrame:
    """Candidates of which a numeric field holds something else, with the first such field."""
    bad = [(_present(F.col("record")[name]), name) for name in THRESHOLDS]
    return candidates.select(F.col("observation_family").cast("string").alias("observation_family"), "observation_timestamp", quality.first_reason(bad).alias("field")).where("field is not null")


def _present(json: Column) -> Column:
    return F.coalesce((json != "null") & ~json.rlike(r"^-?\d"), F.lit(False))


# Families of threshold candidates in their order, and the condition under which a type is known.
THRESHOLD_FAMILIES = ["history", "latest_snapshot", "profile_state", "derived_evidence"]
THRESHOLD_TYPE = "LACTATE_THRESHOLD"
_TARGETS = {"lactateThresholdSpeed": "lactate_threshold_speed", "lactateThresholdHeartRate": "lactate_threshold_heart_rate", "functionalThresholdPower": "functional_threshold_power"}


def _threshold_rows(rows: DataFrame) -> DataFrame:
    """Objects of the four families with what is read of them and the review conditions they meet."""
    raw = lambda n: F.col("record")[n]
    history, meta = F.col("observation_family") == "history", raw("metaData")
    rows = rows.withColumns({"is_object": F.coalesce(coerce.is_object(meta), F.lit(False)), "date_json": F.when(history, coerce.field(meta, "calendarDate")), "sequence_json": F.when(history, coerce.field(meta, "sequence"))})
    rows = rows.withColumns({"observation_timestamp": times.bound(F.col("date_json"), times.date_label), "sequence": F.coalesce(coerce.integer(F.col("sequence_json")), F.lit(0))})
    stopped = F.when(history & ~F.col("is_object"), "history_metadata_missing").when(history & F.col("observation_timestamp").isNull(), "history_timestamp_missing_or_invalid")
    invalid = [F.when(F.coalesce(raw(n) != "null", F.lit(False)) & coerce.number(raw(n), strings=False, bounded="none").isNull(), F.lit(f"invalid_{t}")) for n, t in _TARGETS.items()]
    reviews = F.when(stopped.isNotNull(), F.array(stopped)).otherwise(F.array_compact(F.array(*invalid)))
    kind = F.when((F.col("observation_family") == "derived_evidence") & (raw("trainingMethod") == f'"{THRESHOLD_TYPE}"'), THRESHOLD_TYPE)
    return rows.withColumns({"stopped": stopped.isNotNull(), "reviews": reviews, **{t: coerce.number(raw(n), strings=False, bounded="none") for n, t in _TARGETS.items()}, "lactate_threshold_type": kind})


_CANDIDATE = ["observation_timestamp", "observation_family", *_TARGETS.values(), "lactate_threshold_type"]


def collect_thresholds(rows: DataFrame) -> dict[str, DataFrame]:
    """Threshold candidates of all families, none of which is promoted: ``rows`` have ``observation_family`` and ``record``, a map of canonical JSON.

    * ``candidates``: different normalized rows, with their ``place`` among those of one family and time. Source numbers (sequence) order them but aren't shown.
    * ``reviews``: how often each review condition was met; several different powers of one family and time are one.
    * ``families``: source objects of each family.
    """
    read = _threshold_rows(rows)
    some = F.lit(False)
    for c in _CANDIDATE[2:]:
        some = some | F.col(c).isNotNull()
    unique = read.where(~F.col("stopped") & some).groupBy(*_CANDIDATE).agg(F.min("sequence").alias("sequence"))
    power = F.count_distinct("functional_threshold_power").alias("powers")
    conflicts = unique.groupBy("observation_family", "observation_timestamp").agg(power).where("powers > 1").select(F.lit("functional_threshold_power_conflict").alias("condition"))
    reviews = read.select(F.explode("reviews").alias("condition")).union(conflicts).groupBy("condition").agg(F.count("*").alias("review_count"))
    order = Window.partitionBy("observation_family", "observation_timestamp").orderBy("sequence", *_CANDIDATE[2:])
    return {"candidates": unique.withColumn("place", F.row_number().over(order)).drop("sequence"), "reviews": reviews, "families": rows.groupBy("observation_family").agg(F.count("*").alias("source_record_count"))}
