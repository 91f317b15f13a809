"""Queries that run the dataset plans over source records made of the driver's tables, and SQL with the same rows.

Each record is a map of field to canonical JSON text, as the readers of files give it, with what exports hold in fact:
absent and null fields, numbers as text, repeated records, bad dates.  One record stands for all orders of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelake.functions import coerce
from pacelake.plans import datasets, health, variability

_DAYS = "dd AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*)::BIGINT AS n, min(o_orderkey) AS k FROM orders GROUP BY 1)"
#: Milliseconds of a time of day in 2024, to which a row's number of seconds is added.
_EPOCH = 1_704_067_200_000


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _days(spark, d) -> DataFrame:
    return _table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))


def q(text: Column) -> Column:
    return F.concat(F.lit('"'), text.cast("string"), F.lit('"'))


def num(value: Column) -> Column:
    return value.cast("string")


def every(m: int, value: Column, other: Column | None = None) -> Column:
    """``value`` for rows of which k is divisible by m, else ``other`` (by default absent)."""
    return F.when(F.col("k") % m == 0, value) if other is None else F.when(F.col("k") % m == 0, value).otherwise(other)


def _records(rows: DataFrame, family: str, fields: dict[str, Column], path: Column | None = None, parent: Column | None = None) -> DataFrame:
    """Source rows; those of which k is divisible by 4 come twice."""
    record = F.map_filter(F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]), lambda _, v: v.isNotNull())
    path = F.lit(f"DI/{family}.json") if path is None else path
    out = rows.select(path.alias("provenance_path"), F.sha2(path, 256).alias("sha256"), F.col("k").alias("record_index"), (F.lit(None).cast("string") if parent is None else parent).alias("parent"), record.alias("record"), F.lit(family).alias("family"), "k")
    return out.union(out.where("k % 4 = 0")).drop("k") if parent is None else out.drop("k")


def _dated(spark, d, family: str, fields: dict[str, Column], **more) -> DataFrame:
    return _records(_days(spark, d), family, {"calendarDate": q(every(29, F.lit("bad"), F.col("d")))} | fields, **more)


N, K, D = "n", "k", "d"


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    """-1 for null, where a column may hold nothing else, so that results compare by value."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1).cast(df.schema[c].dataType)) for c in columns})


def dataset_hill_score(spark, d):
    rows = _dated(spark, d, "hill_score", {"overallScore": every(13, q(F.col(N)), num(F.col(N))), "strengthScore": num(F.col(K) % 100), "enduranceScore": every(2, q(F.col(N)), num(F.col(N))), "hillScoreFeedbackPhraseId": F.lit("null"), "deviceId": F.lit("1")})
    return _filled(datasets.daily(rows, "hill_score_daily").records, "endurance_score", "classification_id", "feedback_phrase_id")


def dataset_endurance_score(spark, d):
    rows = _dated(spark, d, "endurance_score", {"overallScore": every(13, q(F.col(N)), num(F.col(N) + 0.5)), "classification": num(F.col(N)), "feedbackPhrase": F.lit("true")})
    return _filled(datasets.daily(rows, "endurance_score_daily").records, "feedback_phrase")


def dataset_race_prediction(spark, d):
    rows = _dated(spark, d, "race_prediction", {"timestamp": q(F.concat(D, F.lit("T01:00:00.0"))), "raceTime5K": num(F.col(K) % 1000), "raceTime10K": q(F.lit(3100)), "raceTimeHalf": every(17, F.lit("null"), F.lit("7000")), "raceTimeMarathon": num(F.lit(15000) + F.col(N))})
    return datasets.daily(rows, "race_prediction_daily").records


def dataset_race_excluded(spark, d):
    """Rows left out, by the first rule that fails."""
    rows = _dated(spark, d, "race_prediction", {"timestamp": every(3, q(F.lit("soon")), q(F.concat(D, F.lit("T01:00:00.0")))), "raceTime5K": num(F.col(K) % 5), "raceTime10K": F.lit("1"), "raceTimeHalf": F.lit("1"), "raceTimeMarathon": F.lit("1")})
    return datasets.daily(rows, "race_prediction_daily").excluded.groupBy("exclusion_reason").agg(F.count("*").alias("row_count"))


def dataset_acute_load(spark, d):
    rows = _dated(spark, d, "acute_training_load", {"timestamp": num(F.lit(_EPOCH) + F.col(K) * 1000), "acwrPercent": num(F.col(N)), "acwrStatus": every(3, q(F.lit("")), q(F.lit("OPTIMAL"))), "dailyTrainingLoadAcute": num(F.col(N) * 10), "dailyTrainingLoadChronic": every(5, F.lit("true"), F.lit("100")), "dailyAcuteChronicWorkloadRatio": q(F.col(N) / 4)})
    return datasets.daily(rows, "acute_training_load_daily").records


def dataset_readiness(spark, d):
    rows = _dated(spark, d, "training_readiness", {"timestamp": q(F.concat(D, F.lit("T12:00:00+09:00"))), "score": num(F.col(N)), "level": q(F.lit("HIGH")), "recoveryTime": F.lit("[]"), "validSleep": every(2, F.lit("true"), every(3, q(F.lit("true")), F.lit("false"))), "sleepScore": num(F.col(K) % 100), "acuteLoad": F.lit("9007199254740992")})
    out = datasets.daily(rows, "training_readiness_daily").records.select("calendar_date", "observation_timestamp", "training_readiness_score", "training_readiness_level", "training_readiness_recovery_time", F.col("training_readiness_valid_sleep").cast("string").alias("training_readiness_valid_sleep"), "training_readiness_sleep_score", "training_readiness_acute_load")
    return _filled(out, "training_readiness_recovery_time", "training_readiness_acute_load")


def dataset_history(spark, d):
    rows = _dated(spark, d, "training_history", {"timestamp": q(F.concat(D, F.lit("T00:30:00Z"))), "trainingStatus": every(7, q(F.lit("")), q(F.concat(F.lit("S"), F.col(N)))), "sport": q(F.lit("RUNNING"))})
    return datasets.daily(rows, "training_history_daily").records


def dataset_vo2max(spark, d):
    path = F.when(F.col(K) % 2 == 0, "DI/ActivityVo2Max_1.json").otherwise("DI/MetricsMaxMetData_1.json")
    rows = _dated(spark, d, "vo2max", {"timestampGmt": q(F.concat(D, F.lit("T10:00:00.0"))), "updateTimestamp": q(F.concat(D, F.lit("T11:00:00"))), "vo2MaxValue": every(5, q(F.lit("high")), q(F.col(N) + 40)), "sport": every(7, F.lit("null"), q(F.lit("RUNNING"))), "activityId": num(F.col(K)), "maxMet": num(F.col(N))}, path=path)
    return datasets.vo2max(rows).records.select("calendar_date", "vo2max_source_series", "sport", "observation_timestamp", "vo2max", "source_activity_id", "max_met")


def dataset_uds(spark, d):
    stress = F.concat(F.lit('{"aggregatorList":[{"averageStressLevel":9,"type":"AWAKE"},{"averageStressLevel":'), F.col(N).cast("string"), F.lit(',"type":"total"},{"averageStressLevel":1,"type":"TOTAL"}]}'))
    rows = _dated(spark, d, "uds", {
        "date": q(F.col(D)), "totalSteps": every(5, F.lit("null"), every(3, num(F.col(N) * 100))), "steps": num(F.col(N)), "distanceMeters": q(F.col(N) + 0.5), "activeKilocalories": num(F.col(N)), "restingHeartRate": every(3, F.lit("true"), num(F.col(N) + 50)),
        "bodyBattery": every(2, F.concat(F.lit('{"chargedValue":'), F.col(N).cast("string"), F.lit("}")), F.lit("[]")), "allDayStress": every(2, stress),
    })
    return _filled(datasets.uds(rows).records.select("calendar_date", "steps", "distance_meters", "active_calories", "resting_heart_rate", "bb_charged_value", "bb_drained_value", "stress_total_averageStressLevel", "raw_has_body_battery", "raw_has_all_day_stress"), "bb_drained_value")


def _sleep(spark, d) -> DataFrame:
    return _records(_days(spark, d), "sleep", {
        "calendarDate": every(6, F.lit("null"), q(F.col(D))), "sleepStartTimestampGMT": every(11, F.lit("null"), q(F.concat(D, F.lit("T13:00:00.0")))), "sleepEndTimestampGMT": q(F.concat(D, every(7, F.lit("T12:00:00.0"), F.lit("T14:30:00.0")))),
        "deepSleepSeconds": every(3, F.lit("null"), F.lit("3600")), "lightSleepSeconds": every(3, F.lit("null"), q(F.lit(7200))), "remSleepSeconds": every(3, F.lit("null"), num(F.col(N) * 60)), "sleepTimeSeconds": F.lit("600"), "durationInSeconds": F.lit("600.0"),
        "sleepScores": every(2, F.concat(F.lit('{"overall":{"value":'), F.col(N).cast("string"), F.lit("}}"))), "sleepScore": every(5, num(F.col(K) % 100)),
    })


def dataset_sleep(spark, d):
    return datasets.sleep(_sleep(spark, d)).records.select("sleep_day", "sleep_start_local", "sleep_end_local", "sleep_window_minutes_including_awake", "sleep_duration_minutes_ex_awake", "sleep_stage_deep_minutes", "sleep_score", "sleep_stage_available_flag", "sleep_normalization_status", "sleep_reason_code")


def sleep_presence(spark, d):
    """Days whose records have equal values but differ in whether a field is there, absent or null: kept as variants, none of them wins."""
    rows = _days(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    second = F.col("copy") == 1
    fields = {"calendarDate": q(F.col(D)), "deepSleepSeconds": F.when(second & (F.col(K) % 5 == 0), F.lit(None)).otherwise(F.when(F.col(K) % 5 == 0, F.lit("null")).otherwise(F.lit("0"))), "sleepScore": F.when(second & (F.col(K) % 3 == 0), F.lit("null")), "retro": F.when(second, F.lit("true"))}
    found = datasets.sleep(_records(rows, "sleep", fields), preserve=True)
    return found.variants.select("sleep_day", "sleep_stage_deep_minutes", "observation_count")


def sleep_records(spark, d):
    """Record-level sleep: every record stays, and all of a day that has several are marked for review."""
    return health.sleep_records(_sleep(spark, d)).select("sleep_day", "sleep_calendar_date_source", "sleep_normalization_status", "sleep_reason_code", "sleep_source_available_for_analysis_flag", "sleep_score", F.col("source_record_index"))


# --- activities and what refers to them ----------------------------------------


def _activities(spark, d) -> DataFrame:
    o = _table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    ms = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long") + F.col("k") * 1000
    fields = {
        "activityId": every(10, F.lit("null"), num(F.col("k"))), "name": q(F.concat(F.lit("A"), F.col("k"))), "description": every(3, q(F.lit("")), q(F.lit("memo"))), "activityType": q(F.lit("running")), "sportType": every(2, q(F.lit("TRAIL")), q(F.lit(" "))),
        "startTimeGmt": every(7, F.lit("null"), num(ms)), "beginTimestamp": num(ms + 500), "distance": num(F.col("o_custkey") * 100 + 5), "duration": num(F.col("k") % 1000 * 1000), "avgHr": every(4, q(F.lit(140)), F.lit("140.5")), "lapCount": every(5, F.lit("2.0"), F.lit("2")),
    }
    return _records(o, "activities", fields, parent=F.lit("x")).withColumn("parent", F.lit(None).cast("string"))


def dataset_activities(spark, d):
    return _filled(datasets.activities(_activities(spark, d)).select("garmin_activity_key", "activity_id", "name", "memo_present", "start_time_gmt_ms", "activity_datetime_local", "activity_date_local", "distance_m", "duration_sec", "avg_hr", "lap_count", "source_confidence"), "lap_count")


def shared_activities(spark, d):
    """The view of activities that leaves for others."""
    return _filled(datasets.shared_view(datasets.activities(_activities(spark, d))), "lap_count")


def private_field_counts(spark, d):
    """How many source rows of a score hold each private field."""
    fields = {"overallScore": num(F.col(N)), "deviceId": F.lit("null"), "timestamp": every(2, num(F.col(K))), "userProfilePK": every(3, F.lit("1")), "note": F.lit("1")}
    return datasets.private_fields(_dated(spark, d, "hill_score", fields))


def number_variants(spark, d):
    """Numbers as the three kinds of sources take them: large ones, texts, booleans and other forms."""
    k = F.col("o_orderkey")
    forms = ["9007199254740991", "9007199254740993", '"9007199254740993"', "1e300", '" 12.5 "', '"12d"', "true", '""', "null", '"1e400"', "-0.5"]
    json = F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int"))
    kinds = {"daily": coerce.number(json), "performance": coerce.number(json, strings=False, bounded="none"), "health": coerce.number(json, bounded="all")}
    return _table(spark, d, "orders").select(json.alias("form"), *[F.coalesce(v, F.lit(-1.0)).alias(n) for n, v in kinds.items()]).groupBy("form", *kinds).agg(F.count("*").alias("row_count"))


def _gear_rows(spark, d) -> DataFrame:
    p = _table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    return _records(p.where("p_size <= 40"), "gear", {"gearPk": every(9, q(F.concat(F.lit(" 00"), F.col("k") + 1)), num(F.col("k") + 1)), "uuid": q(F.col("p_brand")), "displayName": every(3, q(F.lit("")), q(F.concat(F.lit("G"), F.col("k")))), "gearTypeName": every(2, F.lit("null"), q(F.lit("Shoes"))), "gearType": q(F.lit("other")), "maximumMeters": q(F.col("p_size") * 1000)}, parent=F.lit("x"))


def dataset_gear(spark, d):
    return datasets.gear(_gear_rows(spark, d)).select("gear_key", "uuid", "display_name", "gear_type", "maximum_meters")


def _gear_links(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = _table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") + 1).alias("a")).distinct().withColumn("k", F.lit(1))
    links = _records(lines, "gear", {"activityId": num(F.col("a"))}, parent=(F.col("l_partkey") + 1).cast("string"))
    return datasets.activity_gear(links, datasets.activities(_activities(spark, d)), datasets.gear(_gear_rows(spark, d)))


def dataset_activity_gear(spark, d):
    return _gear_links(spark, d)[0].select("gear_key", "activity_id", "garmin_activity_key", "activity_relationship_status", "gear_relationship_status")


def dataset_activity_gear_unresolved(spark, d):
    return _gear_links(spark, d)[1].groupBy("reason").agg(F.count("*").alias("row_count"))


def dataset_personal_records(spark, d):
    c = _table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    rows = _records(c, "personal_records", {"personalRecordId": num(F.col("k") + 1), "activityId": every(6, F.lit("0"), num(F.col("k") * 20 + 1)), "personalRecordType": q(F.col("c_mktsegment")), "value": num(F.col("k") + 0.5), "current": every(2, F.lit("true"), F.lit("false")), "confirmed": q(F.lit("true"))}, parent=F.lit("x"))
    return datasets.personal_records(rows, datasets.activities(_activities(spark, d))).select("personal_record_id", "activity_id", "personal_record_type", "value", "current", F.coalesce(F.col("confirmed").cast("string"), F.lit("neither")).alias("confirmed"), "garmin_activity_key", "activity_relationship_status", "activity_relationship_reason")


def _fit_links(spark, d):
    o = _table(spark, d, "orders").where("o_custkey % 3 <> 2")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(0), F.col("o_orderkey").cast("decimal(18,6)"))
    activities = _table(spark, d, "orders").select(
        F.concat(F.lit("a"), "o_orderkey").alias("garmin_activity_key"), F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).alias("activity_datetime_local"), F.when(F.col("o_orderkey") % 40 != 0, F.col("o_custkey").cast("double") + 1).alias("distance_m"),
        F.when(F.col("o_orderkey") % 40 != 0, F.lit(600.0)).alias("duration_sec"), F.lit(" ").alias("sport_type"), F.lit("street").alias("activity_type"), F.lit("a").alias("source_path"), F.lit("x").alias("source_sha256"),
    )
    late = F.col("o_orderkey") % 4 * 15
    shifted = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(0), (F.col("o_orderkey") + late).cast("decimal(18,6)"))
    sessions = o.select(
        F.concat(F.lit("s"), "o_orderkey").alias("fit_session_key"), F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")).alias("start_datetime_local"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3 * 0.75).alias("distance_m"),
        F.lit(None).cast("double").alias("timer_time_sec"), F.lit(600.5).alias("elapsed_time_sec"), F.when(F.col("o_orderkey") % 5 == 0, "10").otherwise("Trail Running").alias("sport"), F.lit("f").alias("source_path"), F.lit("y").alias("source_sha256"),
    )
    return datasets.activity_fit_links(activities, sessions)


def dataset_activity_fit_links(spark, d):
    return _fit_links(spark, d)[0].select("garmin_activity_key", "fit_session_key", "match_rule", F.array_join("match_basis", ",").alias("match_basis"), "match_score", "time_delta_seconds", "distance_delta_m", "duration_delta_seconds")


def activity_outcomes(spark, d):
    return _fit_links(spark, d)[1]


def session_outcomes(spark, d):
    return _fit_links(spark, d)[2].groupBy("outcome").agg(F.count("*").alias("row_count"))


# --- health status and thresholds ------------------------------------------------


def _health(spark, d) -> DataFrame:
    """A record for each order of which the key is divisible by 5, so that days have none, one or several."""
    o = _table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_custkey").alias("n"))
    hrv = F.concat(F.lit('{"baselineUpperLimit":70,"status":" IN_RANGE ","type":"hrv","value":'), F.col("n").cast("string"), F.lit("}"))
    heart = F.concat(F.lit('{"percentage":"50.5","type":"HR","value":'), F.when(F.col("k") % 4 == 0, '"fast"').otherwise(F.col("n").cast("string")), F.lit("}"))
    metrics = F.concat(F.lit("["), F.concat_ws(",", hrv, heart, F.when(F.col("k") % 3 == 0, hrv), F.when(F.col("k") % 7 == 0, F.lit('{"type":"GLOW","value":1}')), F.lit("7")), F.lit("]"))
    fields = {"calendarDate": every(11, F.lit("null"), q(F.col("d"))), "updateTimestampUTC": every(2, q(F.concat("d", F.lit("T10:00:00"))), F.lit("null")), "createTimestampUTC": q(F.concat("d", F.lit("T08:00:00+09:00"))), "metrics": every(9, F.lit("null"), metrics)}
    return _records(o, "health_status", fields, parent=F.lit("x"))


def health_metrics_long(spark, d):
    return health.health_status(_health(spark, d))[1].select("health_status_metric_record_key", "calendar_date", "metric_type", "value", "baseline_upper_limit", "percentage", "status", "metric_normalization_status", "metric_reason_code", "daily_selection_status")


def health_status_daily(spark, d):
    return health.health_status(_health(spark, d))[0].select("health_status_daily_record_key", "calendar_date", "update_timestamp_utc", "source_metric_count", "unknown_metric_count", "daily_duplicate_count_before_dedupe", "daily_dedupe_method", "health_status_normalization_status", "health_status_reason_code", "health_status_hrv_value", "health_status_hrv_status", "health_status_hr_value", "health_status_hr_percentage")


def _thresholds(spark, d) -> DataFrame:
    o = _table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    return o.select((F.col("k") % 3).alias("observation_family"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("observation_timestamp"), F.create_map(F.lit("functionalThresholdPower"), F.when(F.col("k") % 17 == 0, q(F.lit("high"))).when(F.col("k") % 5 == 0, F.lit("null")).otherwise((F.col("o_custkey") % 3 + 250).cast("string")), F.lit("lactateThresholdSpeed"), F.when(F.col("k") % 19 == 0, F.lit("true")).otherwise(F.lit("3.5"))).alias("record"))


def lactate_power_conflicts(spark, d):
    return health.power_conflicts(_thresholds(spark, d))


def lactate_candidates(spark, d):
    return health.threshold_counts(_thresholds(spark, d))


def lactate_malformed(spark, d):
    return health.malformed_thresholds(_thresholds(spark, d)).groupBy("observation_family", "field").agg(F.count("*").alias("row_count"))


def _candidates(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    key = F.col("o_orderkey")
    return variability.daily_candidates(o.select(F.when(key % 50 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(key % 5 != 0, (F.col("o_custkey") % 2 + 40).cast("double")).alias("value"), (key % 3 == 0).alias("invalid"), (key % 2).alias("file")))


def _references(spark, d) -> DataFrame:
    o = _table(spark, d, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), (F.col("o_custkey") % 2 + 40).alias("n"))
    one = lambda v: F.concat(F.lit('{"type":"HRV","value":'), v.cast("string"), F.lit("}"))
    metrics = F.concat(F.lit("["), F.concat_ws(",", F.when(F.col("k") % 7 != 0, one(F.col("n") + 9)), F.lit('{"type":"HR","value":1}'), F.when((F.col("k") % 7 != 0) & (F.col("k") % 4 == 0), one(F.col("n"))), F.when(F.col("k") % 35 == 1, F.lit('{"type":"hrv","value":"-"}'))), F.lit("]"))
    return variability.references(_records(o, "health_status", {"calendarDate": every(30, F.lit("null"), q(F.col("d"))), "metrics": metrics}, parent=F.lit("x")))


def hrv_candidates(spark, d):
    return _candidates(spark, d)


def hrv_references(spark, d):
    return _references(spark, d)


def hrv_consistency(spark, d):
    return variability.consistency(_candidates(spark, d), _references(spark, d))


_BAD = "k % 29 <> 0"
_JST = "strftime(u + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00'"

_ACT = """
    o AS (SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) // 1000 + o_orderkey * 1000 AS ms FROM orders),
    s AS (SELECT *, CASE WHEN k % 7 = 0 THEN ms + 500 ELSE ms END AS start, CASE WHEN k % 10 <> 0 THEN k::VARCHAR END AS id FROM o),
    act AS (SELECT *, coalesce('garmin_activity:' || id, 'garmin_activity_hash:' || substr(sha256('[' || start || ',' || (c * 100 + 5) || ',' || (k % 1000 * 1000) || ',"running"]'), 1, 24)) AS key FROM s)"""
_GEAR = "g AS (SELECT p_partkey AS k, p_brand, p_size FROM part WHERE p_size <= 40)"
_LINKS = f"""{_ACT}, {_GEAR},
    l AS (SELECT DISTINCT l_partkey + 1 AS gear, l_orderkey + 1 AS a FROM lineitem),
    r AS (SELECT l.*, g.k IS NOT NULL AS has_gear, act.key FROM l LEFT JOIN g ON g.k + 1 = gear LEFT JOIN act ON act.id = a::VARCHAR)"""
_FIT = """
    a AS (SELECT o_orderkey AS k, epoch(o_orderdate) + o_orderkey AS t, o_custkey + 1.0 AS dist FROM orders),
    ea AS (SELECT * FROM a WHERE k % 50 <> 0 AND k % 40 <> 0),
    s AS (SELECT o_orderkey AS k, epoch(o_orderdate) + o_orderkey + o_orderkey % 4 * 15 AS t, o_custkey + 1 + o_orderkey % 3 * 0.75 AS dist, o_orderkey % 5 <> 0 AS run FROM orders WHERE o_custkey % 3 <> 2),
    p AS (SELECT ea.k AS ak, s.k AS sk, abs(ea.t - s.t) AS dt, abs(ea.dist - s.dist) AS dd, run FROM ea JOIN s ON s.t BETWEEN ea.t - 60 AND ea.t + 60),
    c AS (SELECT *, CASE WHEN dt = 0 THEN 1000 + 100 * (run::INT + (dd <= 200)::INT + 1) WHEN run AND dd <= 1 THEN 800 + floor(60 - dt) END::BIGINT AS score FROM p),
    f AS (SELECT *, score = max(score) OVER (PARTITION BY ak) AS ta, score = max(score) OVER (PARTITION BY sk) AS ts FROM c WHERE score IS NOT NULL),
    h AS (SELECT *, sum(ta::INT) OVER (PARTITION BY ak) AS an, sum(ts::INT) OVER (PARTITION BY sk) AS sn FROM f),
    links AS (SELECT * FROM h WHERE ta AND ts AND an = 1 AND sn = 1)"""
_HEALTH = """
    o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS calendar_date, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey AS n,
          'health_status_daily:' || substr(sha256('DI/health_status.json'), 1, 24) || ':' || o_orderkey AS key FROM orders WHERE o_orderkey % 5 = 0),
    m0 AS (SELECT o.*, unnest([0, 1, 2, 3]) AS j FROM o WHERE k % 9 <> 0),
    m1 AS (SELECT *, CASE j WHEN 0 THEN 'HRV' WHEN 1 THEN 'HR' WHEN 2 THEN 'HRV' ELSE 'GLOW' END AS metric_type FROM m0 WHERE j < 2 OR (j = 2 AND k % 3 = 0) OR (j = 3 AND k % 7 = 0)),
    m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS i, CASE WHEN metric_type = 'GLOW' THEN 1 WHEN metric_type = 'HR' AND k % 4 = 0 THEN NULL ELSE n END::DOUBLE AS value FROM m1),
    mm AS (SELECT *, CASE WHEN calendar_date IS NULL THEN 'health_status_missing_calendar_date' WHEN value IS NULL THEN 'health_status_metric_value_invalid' ELSE 'health_status_metric_available' END AS reason FROM m),
    sel AS (SELECT *, CASE WHEN calendar_date IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY calendar_date) END AS dup, CASE WHEN calendar_date IS NULL THEN 'missing_date_hold' WHEN row_number() OVER (PARTITION BY calendar_date ORDER BY k % 2, key DESC) = 1 THEN 'selected_for_daily' ELSE 'superseded_for_daily' END AS choice
            FROM o)"""

_HRV = """
    r AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 2 + 40)::DOUBLE END AS value, o_orderkey % 3 = 0 AS invalid, o_orderkey % 2 AS file FROM orders),
    g AS (SELECT date, min(value) FILTER (WHERE NOT invalid) AS lo, max(value) FILTER (WHERE NOT invalid) AS hi, count(*)::BIGINT AS n, count(DISTINCT file)::BIGINT AS files, count(*) FILTER (WHERE invalid)::BIGINT AS bad FROM r WHERE date IS NOT NULL GROUP BY date),
    cand AS (SELECT date, CASE WHEN lo = hi THEN lo END AS value, n AS record_count_for_date, files AS source_file_count_for_date, bad AS invalid_raw_value_count_for_date, CASE WHEN lo IS NOT NULL THEN 'needs_inspection' WHEN bad > 0 THEN 'invalid_raw_value' ELSE 'raw_required_hold' END AS confidence_status,
                CASE WHEN lo <> hi THEN 'same_date_different_valid_values_not_averaged' WHEN lo IS NOT NULL AND bad > 0 THEN 'same_date_valid_value_after_invalid_excluded' WHEN lo IS NOT NULL THEN 'same_date_same_value_deduped' WHEN bad > 0 THEN 'only_invalid_raw_values_excluded' ELSE 'no_valid_value_for_date' END AS dedupe_method FROM g
             UNION ALL SELECT NULL, value, 1, 1, invalid::BIGINT, 'raw_required_hold', 'missing_date_raw_required_hold' FROM r WHERE date IS NULL),
    h0 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 30 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, (o_custkey % 2 + 40)::DOUBLE AS n FROM orders WHERE o_orderkey % 6 = 0),
    h AS (SELECT k, date, k % 7 <> 0 OR k % 35 = 1 AS present, CASE WHEN k % 35 = 1 THEN NULL WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN n ELSE n + 9 END AS value, date IS NOT NULL AND count(*) OVER (PARTITION BY date) > 1 AS several FROM h0),
    refs AS (SELECT date, value, CASE WHEN date IS NULL THEN 'health_status_hrv_missing_calendar_date' WHEN several THEN 'health_status_hrv_duplicate_calendar_date' WHEN NOT present THEN 'health_status_hrv_metric_not_present' WHEN value IS NULL THEN 'health_status_hrv_value_invalid_or_missing' ELSE 'health_status_hrv_reference_available' END AS code, k FROM h)"""

SQL = {
    "hrv_candidates": f"WITH {_HRV} SELECT * FROM cand",
    "hrv_references": f"""WITH {_HRV} SELECT date, value, CASE code WHEN 'health_status_hrv_reference_available' THEN 'reference_available' WHEN 'health_status_hrv_metric_not_present' THEN 'reference_missing' ELSE 'needs_review' END AS reference_status, code AS reference_reason_code, k AS record_index FROM refs""",
    "hrv_consistency": f"""WITH {_HRV}, a AS (SELECT date, value AS x FROM cand WHERE date IS NOT NULL), b AS (SELECT date, count(*) AS n, CASE WHEN count(*) = 1 THEN max(value) END AS y FROM refs WHERE date IS NOT NULL GROUP BY date)
        SELECT coalesce(a.date, b.date) AS date, x AS fit_hrv_value, y AS health_status_hrv_value, CASE WHEN n > 1 THEN 'needs_review_duplicate_health_status_date' WHEN a.date IS NULL THEN 'health_status_only' WHEN n IS NULL THEN 'fit_only' WHEN x IS NULL OR y IS NULL THEN 'needs_review_missing_value'
            WHEN abs(x - y) <= 1e-9 THEN 'same_date_value_match' ELSE 'same_date_value_difference' END AS consistency_status FROM a FULL JOIN b ON a.date = b.date""",
    "dataset_hill_score": f"WITH {_DAYS} SELECT d AS calendar_date, n AS overall_score, k % 100 AS strength_score, CASE WHEN k % 2 = 1 THEN n ELSE -1 END AS endurance_score, (-1)::BIGINT AS classification_id, (-1)::BIGINT AS feedback_phrase_id FROM dd WHERE {_BAD} AND k % 13 <> 0",
    "dataset_endurance_score": f"WITH {_DAYS} SELECT d AS calendar_date, n + 0.5::DOUBLE AS overall_score, n::DOUBLE AS classification, (-1)::DOUBLE AS feedback_phrase FROM dd WHERE {_BAD} AND k % 13 <> 0",
    "dataset_race_prediction": f"WITH {_DAYS} SELECT d AS calendar_date, d || 'T01:00:00' AS observation_timestamp, (k % 1000)::DOUBLE AS race_time_5k_sec, 3100::DOUBLE AS race_time_10k_sec, 7000::DOUBLE AS race_time_half_sec, (15000 + n)::DOUBLE AS race_time_marathon_sec FROM dd WHERE {_BAD} AND k % 17 <> 0 AND k % 1000 > 0",
    "dataset_race_excluded": f"""WITH {_DAYS}, e AS (SELECT CASE WHEN k % 29 = 0 THEN 'missing_or_invalid_calendar_date' WHEN k % 3 = 0 THEN 'missing_or_invalid_observation_timestamp' WHEN k % 5 = 0 THEN 'missing_or_invalid_race_prediction' END AS exclusion_reason, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS w FROM dd)
        SELECT exclusion_reason, sum(w)::BIGINT AS row_count FROM e WHERE exclusion_reason IS NOT NULL GROUP BY 1""",
    "dataset_acute_load": f"""WITH {_DAYS} SELECT d AS calendar_date, strftime(make_timestamp(({_EPOCH} + k * 1000) * 1000), '%Y-%m-%dT%H:%M:%S') || 'Z' AS observation_timestamp, n::DOUBLE AS acwr_percent, CASE WHEN k % 3 <> 0 THEN 'OPTIMAL' END AS acwr_status, n * 10::DOUBLE AS daily_training_load_acute,
        CASE WHEN k % 5 <> 0 THEN 100::DOUBLE END AS daily_training_load_chronic, n / 4::DOUBLE AS daily_acute_chronic_workload_ratio FROM dd WHERE {_BAD}""",
    "dataset_readiness": f"""WITH {_DAYS} SELECT d AS calendar_date, d || 'T03:00:00Z' AS observation_timestamp, n::DOUBLE AS training_readiness_score, 'HIGH' AS training_readiness_level, (-1)::DOUBLE AS training_readiness_recovery_time,
        CASE WHEN k % 2 = 0 THEN 'true' WHEN k % 3 = 0 THEN NULL ELSE 'false' END AS training_readiness_valid_sleep, (k % 100)::DOUBLE AS training_readiness_sleep_score, (-1)::DOUBLE AS training_readiness_acute_load FROM dd WHERE {_BAD}""",
    "dataset_history": f"WITH {_DAYS} SELECT d AS calendar_date, d || 'T00:30:00Z' AS observation_timestamp, 'S' || n AS training_status, 'RUNNING' AS sport FROM dd WHERE {_BAD} AND k % 7 <> 0",
    "dataset_vo2max": f"""WITH {_DAYS} SELECT d AS calendar_date, CASE WHEN k % 2 = 0 THEN 'activity_vo2max_daily' ELSE 'performance_metrics_daily' END AS vo2max_source_series, 'RUNNING' AS sport, CASE WHEN k % 2 = 0 THEN d || 'T10:00:00Z' ELSE d || 'T11:00:00' END AS observation_timestamp,
        (n + 40)::DOUBLE AS vo2max, k AS source_activity_id, n::DOUBLE AS max_met FROM dd WHERE {_BAD} AND k % 5 <> 0 AND k % 7 <> 0""",
    "dataset_uds": f"""WITH {_DAYS} SELECT d AS calendar_date, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN n * 100 ELSE n END::DOUBLE AS steps, n + 0.5::DOUBLE AS distance_meters, n::DOUBLE AS active_calories, CASE WHEN k % 3 <> 0 THEN n + 50::DOUBLE END AS resting_heart_rate,
        CASE WHEN k % 2 = 0 THEN n::DOUBLE END AS bb_charged_value, (-1)::DOUBLE AS bb_drained_value, CASE WHEN k % 2 = 0 THEN n::DOUBLE END AS "stress_total_averageStressLevel", k % 2 = 0 AS raw_has_body_battery, k % 2 = 0 AS raw_has_all_day_stress FROM dd""",
    "dataset_sleep": f"""WITH {_DAYS}, x AS (SELECT *, CASE WHEN k % 11 <> 0 THEN d || 'T22:00:00+09:00' END AS s, CASE WHEN k % 7 = 0 THEN 'T21:00:00+09:00' ELSE 'T23:30:00+09:00' END AS e FROM dd)
        SELECT d AS sleep_day, s AS sleep_start_local, d || e AS sleep_end_local, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 7 = 0 THEN -60 ELSE 90 END::DOUBLE END AS sleep_window_minutes_including_awake, CASE WHEN k % 3 = 0 THEN 10 ELSE (10800 + n * 60) / 60 END::DOUBLE AS sleep_duration_minutes_ex_awake,
            CASE WHEN k % 3 <> 0 THEN 60::DOUBLE END AS sleep_stage_deep_minutes, CASE WHEN k % 2 = 0 THEN n WHEN k % 5 = 0 THEN k % 100 END::DOUBLE AS sleep_score, k % 3 <> 0 AS sleep_stage_available_flag, CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN 'needs_review' ELSE 'available' END AS sleep_normalization_status,
            CASE WHEN k % 11 = 0 THEN 'missing_start_or_end_no_inference' WHEN k % 7 = 0 THEN 'invalid_sleep_window_no_inference' ELSE 'sleep_source_available' END AS sleep_reason_code FROM x""",
    "sleep_presence": f"""WITH {_DAYS}, v AS (SELECT d, unnest([0, 1]) AS copy, k FROM dd WHERE k % 5 = 0 OR k % 3 = 0)
        SELECT d AS sleep_day, CASE WHEN k % 5 <> 0 THEN 0::DOUBLE END AS sleep_stage_deep_minutes, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS observation_count FROM v""",
    "sleep_records": f"""WITH {_DAYS}, x AS (SELECT *, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS times FROM dd), y AS (SELECT *, unnest(range(times)) AS i FROM x)
        SELECT d AS sleep_day, CASE WHEN k % 6 <> 0 THEN d END AS sleep_calendar_date_source, CASE WHEN times > 1 OR k % 11 = 0 OR k % 7 = 0 THEN 'needs_review' ELSE 'available' END AS sleep_normalization_status,
            CASE WHEN times > 1 THEN 'sleep_json_duplicate_sleep_day' WHEN k % 11 = 0 THEN 'sleep_json_missing_start_or_end' WHEN k % 7 = 0 THEN 'sleep_json_invalid_sleep_interval' ELSE 'sleep_json_daily_available' END AS sleep_reason_code,
            NOT (times > 1 OR k % 11 = 0 OR k % 7 = 0) AS sleep_source_available_for_analysis_flag, CASE WHEN k % 2 = 0 THEN n WHEN k % 5 = 0 THEN k % 100 END::DOUBLE AS sleep_score, k AS source_record_index FROM y""",
    "dataset_activities": f"""WITH {_ACT} SELECT key AS garmin_activity_key, id AS activity_id, 'A' || k AS name, k % 3 <> 0 AS memo_present, start::DOUBLE AS start_time_gmt_ms,
        strftime(make_timestamp(start * 1000) + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k % 7 = 0 THEN '.500000' ELSE '' END || '+09:00' AS activity_datetime_local, strftime(make_timestamp(start * 1000) + INTERVAL 9 HOUR, '%Y-%m-%d') AS activity_date_local,
        (c * 100 + 5) / 100.0::DOUBLE AS distance_m, (k % 1000)::DOUBLE AS duration_sec, CASE WHEN k % 4 <> 0 THEN 140.5::DOUBLE END AS avg_hr, CASE WHEN k % 5 <> 0 THEN 2 ELSE -1 END::BIGINT AS lap_count, CASE WHEN id IS NULL THEN 'medium' ELSE 'high' END AS source_confidence FROM act""",
    "shared_activities": f"""WITH {_ACT} SELECT strftime(make_timestamp(start * 1000) + INTERVAL 9 HOUR, '%Y-%m') AS activity_month, 'running' AS activity_type, CASE WHEN k % 2 = 0 THEN 'TRAIL' ELSE ' ' END AS sport_type,
        (c * 100 + 5) / 100.0::DOUBLE AS distance_m, (k % 1000)::DOUBLE AS duration_sec, CASE WHEN k % 5 <> 0 THEN 2 ELSE -1 END::BIGINT AS lap_count FROM act""",
    "private_field_counts": f"""WITH {_DAYS}, x AS (SELECT k, unnest(range(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END)) AS i FROM dd)
        SELECT 'deviceId' AS field_name, count(*)::BIGINT AS row_count FROM x UNION ALL SELECT 'timestamp', count(*)::BIGINT FROM x WHERE k % 2 = 0 UNION ALL SELECT 'userProfilePK', count(*)::BIGINT FROM x WHERE k % 3 = 0""",
    "number_variants": """WITH f AS (SELECT * FROM (VALUES (0, '9007199254740991', 9007199254740991::DOUBLE, 9007199254740991::DOUBLE, 9007199254740991::DOUBLE), (1, '9007199254740993', -1, 9007199254740992::DOUBLE, -1), (2, '"9007199254740993"', 9007199254740992::DOUBLE, -1, -1), (3, '1e300', 1e300, 1e300, -1),
        (4, '" 12.5 "', 12.5, -1, 12.5), (5, '"12d"', -1, -1, -1), (6, 'true', -1, -1, -1), (7, '""', -1, -1, -1), (8, 'null', -1, -1, -1), (9, '"1e400"', -1, -1, -1), (10, '-0.5', -0.5, -0.5, -0.5)) t(i, form, daily, performance, health))
        SELECT form, daily::DOUBLE AS daily, performance::DOUBLE AS performance, health::DOUBLE AS health, count(*)::BIGINT AS row_count FROM orders JOIN f ON i = o_orderkey % 11 GROUP BY ALL""",
    "dataset_gear": f"WITH {_GEAR} SELECT (k + 1)::VARCHAR AS gear_key, p_brand AS uuid, CASE WHEN k % 3 <> 0 THEN 'G' || k END AS display_name, CASE WHEN k % 2 = 0 THEN 'other' ELSE 'Shoes' END AS gear_type, p_size * 1000::DOUBLE AS maximum_meters FROM g",
    "dataset_activity_gear": f"WITH {_LINKS} SELECT gear::VARCHAR AS gear_key, a::VARCHAR AS activity_id, key AS garmin_activity_key, 'RESOLVED' AS activity_relationship_status, 'RESOLVED' AS gear_relationship_status FROM r WHERE has_gear AND key IS NOT NULL",
    "dataset_activity_gear_unresolved": f"""WITH {_LINKS} SELECT reason, count(*)::BIGINT AS row_count FROM (SELECT 'gear_relationship_unresolved_valid_link' AS reason FROM r WHERE NOT has_gear UNION ALL SELECT 'activity_relationship_unresolved_valid_link' FROM r WHERE key IS NULL) GROUP BY 1""",
    "dataset_personal_records": f"""WITH {_ACT}, c AS (SELECT c_custkey AS k, c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN '0' ELSE (c_custkey * 20 + 1)::VARCHAR END AS a FROM customer)
        SELECT (c.k + 1)::VARCHAR AS personal_record_id, a AS activity_id, c_mktsegment AS personal_record_type, c.k + 0.5::DOUBLE AS value, c.k % 2 = 0 AS current, 'neither' AS confirmed, CASE WHEN a <> '0' THEN act.key END AS garmin_activity_key,
            CASE WHEN a = '0' THEN 'INDEPENDENT' ELSE 'RESOLVED' END AS activity_relationship_status, CASE WHEN a = '0' THEN 'independent' ELSE 'linked' END AS activity_relationship_reason FROM c LEFT JOIN act ON act.id = a WHERE a = '0' OR act.key IS NOT NULL""",
    "dataset_activity_fit_links": f"""WITH {_FIT} SELECT 'a' || ak AS garmin_activity_key, 's' || sk AS fit_session_key, CASE WHEN dt = 0 THEN 'exact_start_with_corroboration' ELSE 'near_start_exact_metrics' END AS match_rule,
        CASE WHEN dt = 0 THEN 'start_datetime_local' || CASE WHEN run THEN ',compatible_sport' ELSE '' END || CASE WHEN dd <= 200 THEN ',distance_within_200m' ELSE '' END || ',duration_within_5s' ELSE 'start_datetime_local,compatible_sport,distance_within_1m,duration_within_1s' END AS match_basis,
        score AS match_score, dt::DOUBLE AS time_delta_seconds, dd::DOUBLE AS distance_delta_m, 0.5::DOUBLE AS duration_delta_seconds FROM links""",
    "activity_outcomes": f"""WITH {_FIT} SELECT 'a' || a.k AS garmin_activity_key, CASE WHEN l.ak IS NOT NULL THEN 'linked' WHEN a.k % 50 = 0 OR a.k % 40 = 0 THEN 'excluded' WHEN g.n IS NULL THEN 'no_evidence_qualified_candidate' WHEN g.n > 1 THEN 'ambiguous_candidate' ELSE 'one_to_one_conflict' END AS outcome
        FROM a LEFT JOIN links l ON l.ak = a.k LEFT JOIN (SELECT ak, max(an) AS n FROM h GROUP BY ak) g ON g.ak = a.k""",
    "session_outcomes": f"""WITH {_FIT} SELECT CASE WHEN l.sk IS NOT NULL THEN 'linked' WHEN g.n IS NULL THEN 'no_evidence_qualified_candidate' WHEN g.n > 1 THEN 'ambiguous_candidate' ELSE 'one_to_one_conflict' END AS outcome, count(*)::BIGINT AS row_count
        FROM s LEFT JOIN links l ON l.sk = s.k LEFT JOIN (SELECT sk, max(sn) AS n FROM h GROUP BY sk) g ON g.sk = s.k GROUP BY 1""",
    "health_metrics_long": f"""WITH {_HEALTH} SELECT key || ':metric:' || i AS health_status_metric_record_key, mm.calendar_date, metric_type, value, CASE WHEN metric_type = 'HRV' THEN 70::DOUBLE END AS baseline_upper_limit, CASE WHEN metric_type = 'HR' THEN 50.5::DOUBLE END AS percentage, CASE WHEN metric_type = 'HRV' THEN 'IN_RANGE' END AS status,
        CASE WHEN reason = 'health_status_metric_available' THEN 'available' ELSE 'needs_review' END AS metric_normalization_status, reason AS metric_reason_code, choice AS daily_selection_status FROM mm JOIN sel USING (key)""",
    "health_status_daily": f"""WITH {_HEALTH}, c AS (SELECT key, count(*) AS n_metrics, count(*) FILTER (WHERE metric_type = 'GLOW') AS unknown, count(*) FILTER (WHERE metric_type = 'HRV') AS hrvs, bool_or(reason <> 'health_status_metric_available') AS review FROM mm GROUP BY key),
        w AS (SELECT sel.*, coalesce(n_metrics, 0) AS n_metrics, coalesce(unknown, 0) AS unknown, coalesce(hrvs, 0) AS hrvs, CASE WHEN calendar_date IS NULL THEN 'health_status_missing_calendar_date' WHEN n_metrics IS NULL THEN 'health_status_no_metrics' WHEN hrvs > 1 THEN 'health_status_duplicate_metric_type' WHEN review THEN 'health_status_metric_requires_review'
              WHEN dup > 1 THEN 'health_status_duplicate_calendar_date_resolved' ELSE 'health_status_daily_available' END AS reason FROM sel LEFT JOIN c USING (key) WHERE choice <> 'superseded_for_daily')
        SELECT key AS health_status_daily_record_key, calendar_date, CASE WHEN k % 2 = 0 THEN d || 'T10:00:00+00:00' END AS update_timestamp_utc, n_metrics::BIGINT AS source_metric_count, unknown::BIGINT AS unknown_metric_count, dup::BIGINT AS daily_duplicate_count_before_dedupe,
            CASE WHEN dup > 1 THEN 'latest_update_then_create_then_stable_key' ELSE 'not_needed_unique_calendar_date' END AS daily_dedupe_method, CASE reason WHEN 'health_status_daily_available' THEN 'available' WHEN 'health_status_duplicate_calendar_date_resolved' THEN 'available_with_explicit_dedupe' ELSE 'needs_review' END AS health_status_normalization_status,
            reason AS health_status_reason_code, CASE WHEN hrvs = 1 THEN n::DOUBLE END AS health_status_hrv_value, CASE WHEN hrvs = 1 THEN 'IN_RANGE' END AS health_status_hrv_status, CASE WHEN n_metrics > 0 AND k % 4 <> 0 THEN n::DOUBLE END AS health_status_hr_value, CASE WHEN n_metrics > 0 THEN 50.5::DOUBLE END AS health_status_hr_percentage FROM w""",
    "lactate_power_conflicts": """SELECT (o_orderkey % 3)::VARCHAR AS observation_family, strftime(o_orderdate, '%Y-%m-%d') AS observation_timestamp, count(DISTINCT CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE (o_custkey % 3)::VARCHAR END)::BIGINT AS candidate_count FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 5 <> 0 GROUP BY 1, 2 HAVING candidate_count > 1""",
    "lactate_candidates": """WITH x AS (SELECT (o_orderkey % 3)::VARCHAR AS f, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_orderkey % 17 = 0 THEN 'high' WHEN o_orderkey % 5 = 0 THEN 'null' ELSE (o_custkey % 3)::VARCHAR END AS p, o_orderkey % 19 = 0 AS s, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS bad FROM orders)
        SELECT f AS observation_family, count(*)::BIGINT AS observation_count, count(DISTINCT (d, p, s))::BIGINT AS candidate_count, count(*) FILTER (WHERE bad)::BIGINT AS invalid_field_count FROM x GROUP BY 1""",
    "lactate_malformed": "SELECT (o_orderkey % 3)::VARCHAR AS observation_family, CASE WHEN o_orderkey % 19 = 0 THEN 'lactateThresholdSpeed' ELSE 'functionalThresholdPower' END AS field, count(*)::BIGINT AS row_count FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 GROUP BY 1, 2",
}

QUERIES = {name: globals()[name] for name in SQL}
