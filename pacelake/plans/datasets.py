"""The seventeen normalized datasets of an export, each as one declarative plan over its source rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.functions import coerce, identity, times
from pacelake.operators import dedupe, endpoints, matching, quality, stage
from pacelake.sources import families, fit, wrappers

DEFAULT_TYPES = {"num": "double", "int": "bigint", "text": "string", "bool": "boolean"}


@dataclass(frozen=True)
class Daily:
    """A dataset of daily or timestamped rows: fields as (target, source, kind), what is required, and its key."""

    family: str
    kind: str
    fields: list[tuple[str, str, str]]
    required: list[tuple[str, str]] = field(default_factory=list)  # (condition on targets, reason)
    timestamp: str | None = None
    dates: tuple[str, ...] = ("calendarDate",)

    @property
    def key(self) -> list[str]:
        return ["calendar_date", *(["observation_timestamp"] if self.timestamp else [])]


# Source fields of the daily datasets.
DAILY = {
    "hill_score_daily": Daily("hill_score", "performance", [("overall_score", "overallScore", "int"), ("strength_score", "strengthScore", "int"), ("endurance_score", "enduranceScore", "int"), ("classification_id", "hillScoreClassificationId", "int"), ("feedback_phrase_id", "hillScoreFeedbackPhraseId", "int")], [("overall_score is null", "missing_or_invalid_overall_score")]),
    "endurance_score_daily": Daily("endurance_score", "performance", [("overall_score", "overallScore", "json_num"), ("classification", "classification", "json_num"), ("feedback_phrase", "feedbackPhrase", "json_num")], [("overall_score is null", "missing_or_invalid_overall_score")]),
    "race_prediction_daily": Daily("race_prediction", "daily", [("race_time_5k_sec", "raceTime5K", "num"), ("race_time_10k_sec", "raceTime10K", "num"), ("race_time_half_sec", "raceTimeHalf", "num"), ("race_time_marathon_sec", "raceTimeMarathon", "num")], [("not coalesce(least(race_time_5k_sec, race_time_10k_sec, race_time_half_sec, race_time_marathon_sec) > 0 and race_time_5k_sec is not null and race_time_10k_sec is not null and race_time_half_sec is not null and race_time_marathon_sec is not null, false)", "missing_or_invalid_race_prediction")], "timestamp"),
    "acute_training_load_daily": Daily("acute_training_load", "daily", [("acwr_percent", "acwrPercent", "num"), ("acwr_status", "acwrStatus", "text"), ("daily_training_load_acute", "dailyTrainingLoadAcute", "num"), ("daily_training_load_chronic", "dailyTrainingLoadChronic", "num"), ("daily_acute_chronic_workload_ratio", "dailyAcuteChronicWorkloadRatio", "num")], [], "timestamp"),
    "training_readiness_daily": Daily("training_readiness", "daily", [("training_readiness_score", "score", "num"), ("training_readiness_level", "level", "text"), ("training_readiness_recovery_time", "recoveryTime", "num"), ("training_readiness_acwr_factor_percent", "acwrFactorPercent", "num"), ("training_readiness_stress_history_factor_percent", "stressHistoryFactorPercent", "num"), ("training_readiness_hrv_factor_percent", "hrvFactorPercent", "num"), ("training_readiness_sleep_history_factor_percent", "sleepHistoryFactorPercent", "num"), ("training_readiness_acute_load", "acuteLoad", "num"), ("training_readiness_hrv_weekly_average", "hrvWeeklyAverage", "num"), ("training_readiness_valid_sleep", "validSleep", "bool"), ("training_readiness_sleep_score", "sleepScore", "num")], [], "timestamp"),
    "training_history_daily": Daily("training_history", "daily", [("training_status", "trainingStatus", "text"), ("sport", "sport", "text")], [("training_status is null", "missing_training_status")], "timestamp"),
}

_KINDS = {"num": coerce.number, "json_num": lambda j: coerce.number(j, strings=False, bounded="none"), "int": coerce.integer, "text": coerce.text, "bool": coerce.boolean}


def raw(name: str) -> Column:
    return F.col("record")[name]


def _day(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[times.calendar_date(coerce.any_text(raw(n))) for n in names])


def _rows(assets: DataFrame, family: str, read) -> DataFrame:
    """Source rows of a family, read from files, or as they are where ``assets`` has rows already."""
    mine = assets.where(F.col("family") == family)
    return mine if "record" in assets.columns else wrappers.json_rows(mine, read)


def classify(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``exclusion_reason``, the first rule that holds."""
    return rows.withColumn("exclusion_reason", quality.first_reason([(F.expr(c), r) for c, r in rules]))


@dataclass
class Normalized:
    """Records, rows left out with a reason, variants of divergent keys, and counters."""

    records: DataFrame
    excluded: DataFrame
    variants: DataFrame | None = None
    counters: DataFrame | None = None


def finish(rows: DataFrame, key: list[str], rules: list[tuple[str, str]], preserve: bool) -> Normalized:
    marked = classify(rows, rules)
    fields = [c for c in rows.columns if c not in key]
    records, variants, counters = dedupe.finalize(marked.where("exclusion_reason is null").drop("exclusion_reason"), key, fields, preserve)
    return Normalized(records.select(rows.columns), marked.where("exclusion_reason is not null").select("exclusion_reason"), variants, counters)


def daily(assets: DataFrame, name: str, preserve: bool = False) -> Normalized:
    d = DAILY[name]
    rows = _rows(assets, d.family, lambda v, names=tuple(wrappers.WRAPPERS[d.kind]): wrappers.unwrap(v, list(names)))
    cols = [_day(d.dates).alias("calendar_date")]
    rules = [("calendar_date is null", "missing_or_invalid_calendar_date")]
    if d.timestamp:
        cols.append(times.moment(raw(d.timestamp)).alias("observation_timestamp"))
        rules.append(("observation_timestamp is null", "missing_or_invalid_observation_timestamp"))
    cols += [_KINDS[kind](raw(source)).alias(target) for target, source, kind in d.fields]
    return finish(rows.select(*cols), d.key, rules + d.required, preserve)


def vo2max(assets: DataFrame, preserve: bool = False) -> Normalized:
    rows = _rows(assets, "vo2max", lambda v, names=tuple(wrappers.WRAPPERS["daily"]): wrappers.unwrap(v, list(names)))
    metrics = F.lower(F.regexp_extract("provenance_path", r"([^/!]*)$", 1)).startswith("metricsmaxmetdata")
    series = F.coalesce(coerce.text(raw("vo2MaxSourceSeries")), F.when(metrics, "performance_metrics_daily").otherwise("activity_vo2max_daily"))
    by_activity = series == "activity_vo2max_daily"
    there = lambda n: F.coalesce(~raw(n).isin("null", '""'), F.lit(False))
    chosen = F.when(by_activity & there("timestampGmt"), raw("timestampGmt")).when(~by_activity & there("updateTimestamp"), raw("updateTimestamp")).otherwise(raw("observationTimestamp"))
    moment = times.moment(chosen, by_activity & there("timestampGmt"))
    cols = [_day(("calendarDate",)).alias("calendar_date"), series.alias("vo2max_source_series"), coerce.text(raw("sport")).alias("sport"), moment.alias("observation_timestamp")]
    cols += [coerce.number(raw("vo2MaxValue")).alias("vo2max"), coerce.integer(raw("activityId")).alias("source_activity_id"), F.lit(None).cast("string").alias("source_confidence"), coerce.number(raw("maxMet")).alias("max_met"), coerce.text(raw("maxMetCategory")).alias("max_met_category"), coerce.number(raw("calibratedData")).alias("calibrated_data")]
    rules = [("calendar_date is null", "missing_or_invalid_calendar_date"), ("observation_timestamp is null", "missing_or_invalid_observation_timestamp"), ("vo2max is null", "missing_or_invalid_vo2max"), ("sport is null", "missing_sport_for_stable_key")]
    return finish(rows.select(*cols), ["calendar_date", "vo2max_source_series", "sport", "observation_timestamp"], rules, preserve)


def uds(assets: DataFrame, preserve: bool = False) -> Normalized:
    rows = _rows(assets, "uds", lambda v, names=tuple(wrappers.WRAPPERS["daily"]): wrappers.unwrap(v, list(names)))
    has = F.map_contains_key

    def either(first: str, second: str) -> Column:  # by presence of the key, even of a null
        return F.when(has("record", F.lit(first)), coerce.number(raw(first))).otherwise(coerce.number(raw(second)))

    listed = F.from_json(coerce.field(raw("allDayStress"), "aggregatorList"), "array<map<string,string>>")
    total = F.try_element_at(F.filter(listed, lambda x: F.upper(x["type"]) == "TOTAL"), F.lit(1))
    battery = F.from_json(F.when(coerce.is_object(raw("bodyBattery")), raw("bodyBattery")), "map<string,string>")
    cols = [_day(("calendarDate", "date")).alias("calendar_date"), either("totalSteps", "steps").alias("steps"), either("totalDistanceMeters", "distanceMeters").alias("distance_meters")]
    cols += [coerce.number(raw(s)).alias(t) for t, s in (("active_calories", "activeKilocalories"), ("bmr_calories", "bmrKilocalories"), ("resting_heart_rate", "restingHeartRate"), ("min_heart_rate", "minHeartRate"), ("max_heart_rate", "maxHeartRate"))]
    cols += [battery["chargedValue"].try_cast("double").alias("bb_charged_value"), battery["drainedValue"].try_cast("double").alias("bb_drained_value")]
    cols += [total[n].try_cast("double").alias(f"stress_total_{n}") for n in ("averageStressLevel", "maxStressLevel", "stressDuration", "restDuration")]
    cols += [coerce.is_object(raw(s)).alias(t) for t, s in (("raw_has_body_battery", "bodyBattery"), ("raw_has_all_day_stress", "allDayStress"), ("raw_has_body_battery_feedback", "bodyBatteryFeedback"))]
    return finish(rows.select(*cols), ["calendar_date"], [("calendar_date is null", "missing_or_invalid_calendar_date")], preserve)


# Fields of a sleep record of which it counts, for equality, whether any is there.
SLEEP_PRESENCE = [
    ["calendarDate"], ["sleepStartTimestampGMT"], ["sleepEndTimestampGMT"], ["sleepTimeSeconds", "totalSleepSeconds", "durationInSeconds", "sleepDuration"], ["deepSleepSeconds", "deep_sleep_seconds"],
    ["lightSleepSeconds", "light_sleep_seconds"], ["remSleepSeconds", "rem_sleep_seconds"], ["awakeSleepSeconds", "awake_sleep_seconds"], ["sleepScores", "overallScore", "sleepScore"],
]
# What is said of a record without a start or an end, or with an end that isn't later.
SLEEP_LIMITS = {"missing_start_or_end": "missing_start_or_end_no_inference", "invalid_sleep_window": "invalid_sleep_window_no_inference"}


def sleep(assets: DataFrame, preserve: bool = False) -> Normalized:
    """One record a day. Records of a day are equal if their values are and if the same fields are there: absent and null differ, zero is a value."""
    rows = _rows(assets, "sleep", lambda v, names=tuple(wrappers.WRAPPERS["daily"]): wrappers.unwrap(v, list(names)))

    def instant(name: str) -> Column:
        return times.bound(F.col(name), lambda t: times.observation_timestamp(t, F.lit(False), named_utc=True)[0]).try_cast("timestamp")

    def either(*names: str) -> Column:
        return F.coalesce(*[coerce.number(raw(n)) for n in names])

    presence = [F.arrays_overlap(F.map_keys("record"), F.array(*map(F.lit, group))).cast("int").cast("string") for group in SLEEP_PRESENCE]
    aliases = F.array_compact(F.array(*[coerce.number(raw(n)) for n in SLEEP_PRESENCE[3]]))
    rows = rows.select(
        _day(("calendarDate",)).alias("stated"), coerce.text(raw("sleepStartTimestampGMT")).alias("start"), coerce.text(raw("sleepEndTimestampGMT")).alias("end"), aliases.alias("aliases"), F.concat(*presence).alias("presence"),
        *[either(*SLEEP_PRESENCE[k]).alias(stage) for k, stage in ((4, "deep"), (5, "light"), (6, "rem"), (7, "awake"))],
        F.coalesce(coerce.number(coerce.field(raw("sleepScores"), "overall", "value")), coerce.number(coerce.field(raw("sleepScores"), "overallScore")), coerce.number(raw("overallScore")), coerce.number(raw("sleepScore"))).alias("score"),
    )
    stages, different = F.array_compact(F.array("deep", "light", "rem")), F.size(F.array_distinct("aliases"))
    stated = F.when(different > 1, F.raise_error(F.lit("sleep durations of one record differ")).cast("double")).otherwise(F.try_element_at("aliases", F.lit(1)))
    rows = rows.withColumns({"start": instant("start"), "end": instant("end"), "stages": stages, "duration": F.when(F.size(stages) > 0, F.aggregate(stages, F.lit(0.0), lambda a, b: a + b)).otherwise(stated)})
    rows = rows.withColumn("window", (F.unix_micros("end") - F.unix_micros("start")) / 60e6)
    rows = rows.withColumn("limit", F.when(F.col("start").isNull() | F.col("end").isNull(), "missing_start_or_end").when(F.col("window") <= 0, "invalid_sleep_window"))
    fine = F.col("limit").isNull()
    reason = F.when(fine, "sleep_source_available")
    for limit, text in SLEEP_LIMITS.items():
        reason = reason.when(F.col("limit") == limit, text)
    local = lambda t: times.local_iso(F.unix_millis(t))
    cols = [
        F.coalesce("stated", times.local_day(F.unix_millis("end"))).alias("sleep_day"), local("start").alias("sleep_start_local"), local("end").alias("sleep_end_local"),
        F.col("window").alias("sleep_window_minutes_including_awake"), (F.col("duration") / 60).alias("sleep_duration_minutes_ex_awake"), *[(F.col(n) / 60).alias(f"sleep_stage_{n}_minutes") for n in ("deep", "light", "rem")],
        F.col("score").alias("sleep_score"), (F.col("awake") / 60).alias("sleep_awake_minutes"), (F.size("stages") > 0).alias("sleep_stage_available_flag"), F.col("score").isNotNull().alias("sleep_score_available_flag"),
        F.when(fine, "available").otherwise("needs_review").alias("sleep_normalization_status"), F.coalesce("limit", F.lit("none")).alias("sleep_limitation_type"), reason.alias("sleep_reason_code"), fine.alias("sleep_source_available_for_analysis_flag"), F.col("presence"),
    ]
    found = finish(rows.select(*cols), ["sleep_day"], [("sleep_day is null", "missing_or_invalid_sleep_day")], preserve)
    return Normalized(found.records.drop("presence"), found.excluded, found.variants, found.counters)


def hrv(assets: DataFrame) -> Normalized:
    rows = fit.hrv_rows(assets).withColumn("calendar_date", F.substring(times.fit_iso(F.col("fit_seconds")), 1, 10))
    valid = rows.where("hrv_value is not null and calendar_date is not null")
    each = dedupe.agreed_value(valid, ["calendar_date"], "hrv_value").join(valid.groupBy("calendar_date").agg(F.count_distinct("provenance_path").alias("source_file_count_for_date")), "calendar_date")
    records = each.select("calendar_date", "hrv_value", F.lit("unconfirmed_status_value").alias("semantics_status"), F.lit("context_only").alias("analysis_role"), F.col("record_count").alias("record_count_for_date"), "source_file_count_for_date", "dedupe_status")
    return Normalized(records, classify(rows, [("hrv_value is null", "invalid_value"), ("calendar_date is null", "missing_date")]).where("exclusion_reason is not null").select("exclusion_reason"))


def activities(assets: DataFrame) -> DataFrame:
    rows = _rows(assets, "activities", wrappers.activities)
    num = lambda n: coerce.number(raw(n), strings=False)
    activity_id = coerce.any_text(raw("activityId"))
    start = F.when(raw("startTimeGmt").isNotNull() & (raw("startTimeGmt") != "null"), num("startTimeGmt")).otherwise(num("beginTimestamp"))
    stated = F.when(F.coalesce(raw("startTimeGmt") != "null", F.lit(False)), raw("startTimeGmt")).otherwise(raw("beginTimestamp"))
    fallback = identity.json_hash_key("garmin_activity_hash:", [stated, raw("distance"), raw("duration"), raw("activityType")])
    ms = start.cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("garmin_activity:"), activity_id), fallback).alias("garmin_activity_key"), activity_id.alias("activity_id"), coerce.text(raw("name")).alias("name"), coerce.text(raw("description")).alias("memo_text_raw"),
        F.coalesce(F.trim(coerce.text(raw("description"))) != "", F.lit(False)).alias("memo_present"), coerce.text(raw("activityType")).alias("activity_type"), coerce.text(raw("sportType")).alias("sport_type"), start.alias("start_time_gmt_ms"), coerce.any_text(raw("startTimeLocal")).alias("start_time_local_raw"),
        times.local_iso(ms).alias("activity_datetime_local"), times.local_day(ms).alias("activity_date_local"), num("distance").alias("distance_raw_centimeters"), (num("distance") / 100).alias("distance_m"), num("duration").alias("duration_ms"), (num("duration") / 1000).alias("duration_sec"),
        num("elapsedDuration").alias("elapsed_duration_ms"), num("movingDuration").alias("moving_duration_ms"), num("avgHr").alias("avg_hr"), num("maxHr").alias("max_hr"), num("avgPower").alias("avg_power"), num("maxPower").alias("max_power"), num("avgRunCadence").alias("avg_run_cadence"),
        coerce.text(raw("trainingEffectLabel")).alias("training_effect_label"), num("activityTrainingLoad").alias("activity_training_load"), coerce.integer(raw("lapCount")).alias("lap_count"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"),
        F.when(activity_id.isNotNull(), "high").otherwise("medium").alias("source_confidence"),
    )


# What leaves with the view for others, and fields of scores that never do.
SHARED = ["activity_month", "activity_type", "sport_type", "distance_m", "duration_sec", "lap_count"]
PRIVATE_FIELDS = ["deviceId", "userProfilePk", "userProfilePK", "primaryTrainingDevice", "timestamp", "timestampGmt", "enduranceScoreContributor"]


def shared_view(activities_: DataFrame) -> DataFrame:
    """Activities for others: months instead of dates, and nothing but type and volume."""
    return activities_.withColumn("activity_month", F.coalesce(F.substring("activity_date_local", 1, 7), F.lit(""))).select(SHARED)


def private_fields(rows: DataFrame) -> DataFrame:
    """``field_name, row_count``: in how many source rows each private field is there, be it with null; none of them is in a dataset."""
    found = rows.select(F.explode(F.array_intersect(F.map_keys("record"), F.array(*map(F.lit, PRIVATE_FIELDS)))).alias("field_name"))
    return found.groupBy("field_name").agg(F.count("*").alias("row_count"))


def gear(assets: DataFrame) -> DataFrame:
    rows = _rows(assets, "gear", wrappers.listed("gearDTOS"))
    pk = identity.identity_token(coerce.any_text(raw("gearPk")))
    key = F.coalesce(pk, identity.json_hash_key("garmin_gear_hash:", [raw(n) for n in ("uuid", "displayName", "dateBegin")]))
    return rows.select(key.alias("gear_key"), coerce.text(raw("uuid")).alias("uuid"), coerce.text(raw("displayName")).alias("display_name"), coerce.text(raw("customMakeModel")).alias("custom_make_model"), F.coalesce(coerce.text(raw("gearTypeName")), coerce.text(raw("gearType"))).alias("gear_type"), coerce.text(raw("dateBegin")).alias("date_begin"), coerce.text(raw("dateEnd")).alias("date_end"), coerce.number(raw("maximumMeters")).alias("maximum_meters"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"))


def activity_gear(assets: DataFrame, activities_: DataFrame, gear_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of which both ends resolve, and the reasons for all others."""
    rows = _rows(assets, "gear", wrappers.gear_links)
    links = rows.select(identity.identity_token(F.col("parent")).alias("gear_key"), identity.identity_token(coerce.any_text(raw("activityId"))).alias("activity_id"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"))
    known = endpoints.unique_index(activities_.select(identity.identity_token(F.col("activity_id")).alias("activity_id"), "garmin_activity_key"), "activity_id", "garmin_activity_key")
    found = endpoints.resolve(links, "gear_key", gear_.select("gear_key"), gear_.select("gear_key"), gear_.select("gear_key").where("false"), None, "gear_relationship")
    found = endpoints.resolve(found, "activity_id", known, known, known.where("false"), None, "activity_relationship")
    for name in ("gear_relationship", "activity_relationship"):
        found = endpoints.require_sound(found, name)
    both = endpoints.promoted(found, ["gear_relationship", "activity_relationship"]).join(known, "activity_id")
    out = both.select("gear_key", "activity_id", "garmin_activity_key", "activity_relationship_status", "gear_relationship_status", "source_path", "source_sha256")
    return out, endpoints.unresolved_reasons(found, ["gear_relationship", "activity_relationship"]).select("gear_key", "activity_id", "reason")


def personal_records(assets: DataFrame, activities_: DataFrame) -> DataFrame:
    rows = _rows(assets, "personal_records", wrappers.listed("personalRecords"))
    known = endpoints.unique_index(activities_.select(identity.identity_token(F.col("activity_id")).alias("activity_id"), "garmin_activity_key"), "activity_id", "garmin_activity_key")
    activity_id = identity.identity_token(coerce.any_text(raw("activityId")), allow_zero=True)
    own = identity.identity_token(coerce.any_text(raw("personalRecordId")))
    key = F.coalesce(own, identity.json_hash_key("garmin_personal_record_hash:", [raw(n) for n in ("activityId", "personalRecordType", "value", "prStartTimeGMT")]))
    out = rows.select(key.alias("personal_record_id"), activity_id.alias("activity_id"), coerce.text(raw("personalRecordType")).alias("personal_record_type"), coerce.number(raw("value")).alias("value"), coerce.any_text(raw("prStartTimeGMT")).alias("start_time_gmt"), coerce.any_text(raw("createdDate")).alias("created_date"), coerce.boolean(raw("current")).alias("current"), coerce.boolean(raw("confirmed")).alias("confirmed"), F.col("record_index").alias("source_record_index"), F.col("provenance_path").alias("source_path"), F.col("sha256").alias("source_sha256"), F.when(own.isNotNull(), "high").otherwise("medium").alias("source_confidence"))
    linked = endpoints.optional_link(out, "activity_id", known, F.col("activity_id") == "0").where("link_status <> 'unresolved'")
    return linked.join(known, "activity_id", "left").withColumn("activity_relationship_status", F.when(F.col("link_status") == "independent", "INDEPENDENT").otherwise("RESOLVED")).withColumn("activity_relationship_reason", F.col("link_status")).drop("link_status")


def fit_sessions(decoded: DataFrame) -> DataFrame:
    s = decoded.select("sha256", "source_path", F.col("records").alias("record_count"), F.posexplode("sessions").alias("session_ordinal", "s"))
    key = F.concat(F.lit("fit_session:"), "sha256", F.lit(":"), F.col("session_ordinal").cast("string"))
    names = [("distance_m", "total_distance"), ("elapsed_time_sec", "total_elapsed_time"), ("timer_time_sec", "total_timer_time"), *[(n, n) for n in ("avg_heart_rate", "max_heart_rate", "avg_cadence", "max_cadence", "avg_power", "max_power", "total_ascent", "total_descent")]]
    return s.select(F.concat(F.lit("fit_file:"), F.substring("sha256", 1, 24)).alias("fit_file_id"), key.alias("fit_session_key"), "session_ordinal", times.fit_iso(F.col("s.start_time")).alias("start_datetime_local"), F.col("s.sport").alias("sport"), F.col("s.sub_sport").alias("sub_sport"), *[F.col(f"s.{src}").alias(t) for t, src in names], "record_count", F.size("s.laps").alias("lap_count"), "source_path", F.col("sha256").alias("source_sha256"))


def fit_laps(decoded: DataFrame) -> DataFrame:
    laps = decoded.select("sha256", "source_path", F.posexplode("sessions").alias("session_ordinal", "s")).select("sha256", "source_path", "session_ordinal", F.posexplode("s.laps").alias("lap_ordinal_within_session", "lap"))
    key = F.concat(F.lit("fit_session:"), "sha256", F.lit(":"), F.col("session_ordinal").cast("string"))
    return laps.select(F.concat(F.lit("fit_file:"), F.substring("sha256", 1, 24)).alias("fit_file_id"), key.alias("fit_session_key"), F.concat(key, F.lit(":lap:"), F.col("lap_ordinal_within_session").cast("string")).alias("fit_lap_key"), "session_ordinal", "lap_ordinal_within_session", F.col("lap_ordinal_within_session").alias("lap_index"), times.fit_iso(F.col("lap.start_time")).alias("start_time"), *[F.col(f"lap.{m}").alias(m) for m in fit._LAP_METRICS], times.fit_iso(F.col("lap.timestamp")).alias("timestamp"), "source_path", F.col("sha256").alias("source_sha256"))


def activity_fit_links(activities_: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mutual best links, and the outcome of every activity and of every session."""

    def side(df: DataFrame, key: str, start: str, distance: str, duration: Column, sport: Column, p: str) -> DataFrame:
        us = F.unix_micros(F.col(start).try_cast("timestamp"))
        return df.select(key, us.alias(f"{p}_us"), F.col(distance).alias(f"{p}_distance"), duration.alias(f"{p}_duration"), sport.alias(f"{p}_sport"), F.col("source_path").alias(f"{p}_source_path"), F.col("source_sha256").alias(f"{p}_source_sha256")).withColumn(f"{p}_reason", quality.first_reason([(F.col(f"{p}_us").isNull(), "missing_or_invalid_start_datetime"), (~F.coalesce((F.col(f"{p}_distance") > 0) | (F.col(f"{p}_duration") > 0), F.lit(False)), "missing_or_nonpositive_distance_and_duration")]))

    a = side(activities_, "garmin_activity_key", "activity_datetime_local", "distance_m", F.col("duration_sec"), F.coalesce(families.sport_group(F.col("sport_type")), families.sport_group(F.col("activity_type"))), "activity")
    s = side(sessions, "fit_session_key", "start_datetime_local", "distance_m", F.coalesce("timer_time_sec", "elapsed_time_sec"), families.sport_group(F.col("sport")), "fit")
    pairs = matching.band_join(a.where("activity_reason is null"), s.where("fit_reason is null"), "activity_us", "fit_us", 60_000_000)
    dt, dd, du = F.abs(F.col("activity_us") - F.col("fit_us")) / 1e6, F.abs(F.col("activity_distance") - F.col("fit_distance")), F.abs(F.col("activity_duration") - F.col("fit_duration"))
    same = F.col("activity_sport") == F.col("fit_sport")
    score, rule = matching.evidence_score(dt, same, dd, du)
    exact = F.array(F.lit("start_datetime_local"), F.when(same, "compatible_sport"), F.when(dd <= 200, "distance_within_200m"), F.when(du <= 5, "duration_within_5s"))
    near = F.array(*map(F.lit, ("start_datetime_local", "compatible_sport", "distance_within_1m", "duration_within_1s")))
    basis = F.when(rule == "exact_start_with_corroboration", F.array_compact(exact)).otherwise(near)
    found = pairs.select("*", score.alias("score"), rule.alias("match_rule"), basis.alias("match_basis"), dt.alias("time_delta_seconds"), dd.alias("distance_delta_m"), du.alias("duration_delta_seconds")).where("score is not null")
    ranked = matching.ranked(found, "garmin_activity_key", "fit_session_key")
    best = matching.mutual_best(found, "garmin_activity_key", "fit_session_key")
    links = best.select("garmin_activity_key", "fit_session_key", "match_rule", "match_basis", F.col("score").alias("match_score"), F.lit("linked").alias("match_status"), F.lit(False).alias("ambiguous"), F.lit("eligible").alias("eligibility_status"), F.lit(None).cast("string").alias("exclusion_reason"), "time_delta_seconds", "distance_delta_m", "duration_delta_seconds", "activity_source_path", "activity_source_sha256", "fit_source_path", "fit_source_sha256", F.col("activity_source_path").alias("source_path"), F.col("activity_source_sha256").alias("source_sha256"))
    left = matching.residuals(a, "garmin_activity_key", F.col("activity_reason").isNull(), ranked, "left")
    right = matching.residuals(s, "fit_session_key", F.col("fit_reason").isNull(), ranked, "right")
    return links, left, right


def normalize(spark: SparkSession, assets: DataFrame, preserve: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All seventeen datasets by name, and audit tables by name."""
    decoded = stage.saved(fit.decoded(assets))
    out: dict[str, DataFrame] = {"activities": activities(assets)}
    audits: dict[str, DataFrame] = {"fit_status": decoded.groupBy("status").agg(F.count("*").alias("file_count"))}
    out["gear"] = gear(assets)
    out["activity_gear"], audits["activity_gear_unresolved"] = activity_gear(assets, out["activities"], out["gear"])
    out["personal_records"] = personal_records(assets, out["activities"])
    out["fit_sessions"] = fit_sessions(decoded)
    out["fit_laps"] = fit_laps(decoded).join(out["fit_sessions"].select("fit_session_key"), "fit_session_key", "left_semi")
    out["activity_fit_links"], audits["activity_outcomes"], audits["session_outcomes"] = activity_fit_links(out["activities"], out["fit_sessions"])
    found = {name: daily(assets, name, preserve) for name in DAILY} | {"vo2max_daily": vo2max(assets, preserve), "uds_daily": uds(assets, preserve), "sleep_daily": sleep(assets, preserve), "hrv_daily": hrv(assets)}
    for name, n in found.items():
        out[name] = n.records
        audits[f"{name}_excluded"] = n.excluded.groupBy("exclusion_reason").agg(F.count("*").alias("row_count"))
    return out, audits
