"""Queries that extract observations of datasets from source objects made of the driver's tables, over three snapshots, and merge them; with their SQL.

An object's fields are SQL expressions that Spark and DuckDB read alike; the SQL states on its own which of them are kept, the dates and the keys.
``i`` is the snapshot, ``k`` a number of the object and ``d`` its day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.operators import snapshot
from pacelake.plans import datasets
from pacelake.sources import observations

#: Objects by table: which rows, and in which snapshots they are.
_DAYS = "SELECT CAST(min(o_orderkey) AS BIGINT) AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(NULL AS STRING) AS parent FROM orders GROUP BY CAST(o_orderdate AS DATE)"
_ORDERS = "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(NULL AS STRING) AS parent FROM orders"
_PARTS = "SELECT p_partkey AS k, '2024-01-01' AS d, CAST(NULL AS STRING) AS parent FROM part"
_LINES = "SELECT DISTINCT l_orderkey AS k, '2024-01-01' AS d, CAST(l_suppkey % 50 AS STRING) AS parent FROM lineitem"

_N = "CAST(k % 100 AS STRING)"
_BAD_DAY = "CASE WHEN k % 29 = 0 THEN '\"soon\"' WHEN k % 29 = 1 THEN NULL ELSE '\"' || d || '\"' END"
_DAY = "CASE WHEN k % 29 > 1 THEN d END"

#: By query: the path of the file, the rows, and the fields of an object.
OBJECTS = {
    "activities": ("DI/x_summarizedActivities.json", _ORDERS, {"activityId": "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '\"a' || k || '\"' ELSE CAST(k AS STRING) END", "startTimeGmt": "CASE WHEN k % 2 = 0 THEN 'null' END", "beginTimestamp": "CASE WHEN k % 14 <> 7 THEN CAST(k * 1000 AS STRING) END", "distance": "CASE WHEN k % 14 <> 7 THEN CAST(k % 5 AS STRING) || '.5' END", "activityType": "CASE WHEN k % 14 <> 7 THEN '\"run\"' END", "name": "CASE WHEN (k + i) % 3 = 0 THEN '\"\"' ELSE '\"n' || i || '\"' END"}),
    "gear": ("DI/gear.json", _PARTS, {"gearPk": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '\"\"' ELSE CAST(k AS STRING) END", "uuid": "CASE WHEN k % 8 <> 0 THEN '\"u' || k || '\"' END", "displayName": "CASE WHEN (k + i) % 5 = 0 THEN 'null' END"}),
    "links": ("DI/gear.json", _LINES, {"activityId": "CASE WHEN k % 11 = 0 THEN 'null' ELSE CAST(k AS STRING) END", "gearPk": "'\"' || parent || '\"'"}),
    "personal_records": ("DI/personalRecord.json", _ORDERS, {"personalRecordId": "CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE CAST(k AS STRING) END", "activityId": "CAST(k % 9 AS STRING)", "value": "CAST(k AS STRING)", "personalRecordType": "'\"Fastest 1 km\"'"}),
    "hill": ("DI/HillScore_1.json", _DAYS, {"calendarDate": _BAD_DAY, "overallScore": _N, "deviceId": "'7'", "strengthScore": "CASE WHEN (k + i) % 3 = 0 THEN 'null' END"}),
    "race": ("DI/RunRacePredictions_1.json", _DAYS, {"calendarDate": _BAD_DAY, "timestamp": "CASE WHEN k % 13 = 0 THEN '\"later\"' ELSE '\"' || d || 'T01:30:00.0\"' END", "raceTime5K": _N, "raceTime10K": "CASE WHEN k % 3 = 0 THEN 'null' END", "userProfilePK": "'1'"}),
    "sleep": ("DI/x_sleepData.json", _DAYS, {"calendarDate": _BAD_DAY, "sleepStartTimestampGMT": "'\"' || d || 'T13:00:00.0\"'", "deepSleepSeconds": _N, "sleepScores": "CASE k % 3 WHEN 0 THEN '{}' WHEN 1 THEN 'null' END", "retro": "'true'"}),
    "uds": ("DI/UDSFile_1.json", _DAYS, {"calendarDate": _BAD_DAY, "date": "CASE WHEN k % 2 = 0 THEN '\"' || d || 'T09:00:00\"' END", "totalSteps": _N, "steps": "CASE WHEN (k + i) % 4 = 0 THEN 'null' END", "uuid": "'\"x\"'"}),
    "vo2max": ("DI/ActivityVo2Max_1.json", _DAYS, {"calendarDate": _BAD_DAY, "timestampGmt": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '\"never\"' ELSE '\"' || d || ' 10:00:00\"' END", "observationTimestamp": "CASE WHEN k % 5 < 2 AND k % 2 = 0 THEN '\"' || d || 'T11:00:00\"' END", "sport": "CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '\"\"' ELSE '\"RUNNING\"' END", "vo2MaxValue": _N, "deviceId": "'1'"}),
    "lactate": ("DI/userBioMetrics.json", _ORDERS, {"functionalThresholdPower": "CASE WHEN k % 3 <> 0 THEN CAST(k % 40 AS STRING) END", "lactateThresholdSpeed": "CASE WHEN k % 6 = 0 THEN 'null' END", "metaData": "CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{\"calendarDate\":\"' || d || '\",\"secret\":1,\"sequence\":' || (k % 3) || '}' END", "weight": "'70'"}),
}

#: Of some families an object is missing in one of the snapshots.
_IN = "(k + i) % 4 <> 0"


def _rows(spark, d, names: list[str]) -> DataFrame:
    """Source objects as ``observations.source_rows`` returns them."""
    for t in ("orders", "part", "lineitem"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"extraction_{t}")
    parts = []
    for name in names:
        path, rows, fields = OBJECTS[name]
        for t in ("orders", "part", "lineitem"):
            rows = rows.replace(f"FROM {t}", f"FROM extraction_{t}")
        base = spark.sql(rows).withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where(_IN)
        record = F.map_filter(F.create_map(*[x for n, e in fields.items() for x in (F.lit(n), F.expr(e).cast("string"))]), lambda _, v: v.isNotNull())
        place = F.col("k").cast("string") if name != "links" else F.concat_ws(":", F.lit("0"), "parent", F.col("k").cast("string"))
        parts.append(base.select(F.lit(path).alias("source_relative_path"), F.sha2(F.concat_ws("/", F.col("i").cast("string"), F.lit(path)), 256).alias("source_object_sha256"), place.alias("source_record_index"), "parent", record.alias("record"), F.concat(F.lit("s"), "i").alias("snapshot_id"), F.col("i").cast("long").alias("logical_order"), F.concat(F.lit("2024-0"), "i", F.lit("-01T00:00:00+00:00")).alias("export_observed_at")))
    rows = reduce(DataFrame.union, parts)
    return rows.withColumn("source", observations.source_index(F.col("source_relative_path")))


def _extracted(name: str):
    def query(spark, d):
        out = observations.observations(_rows(spark, d, [name]))
        return out.select("dataset", "canonical_key", "snapshot_id", "source_record_index", snapshot.stable_json("record").alias("record"))

    query.__doc__ = f"Observations of {name.replace('_', ' ')} over three snapshots: what is kept of each object, and its key."
    return query


_SMALL = ["activities", "gear", "personal_records", "hill", "race", "uds", "vo2max"]


def cumulative_patterns(spark, d):
    """In which snapshots the keys of seven datasets occur, all merged in one plan."""
    return observations.merged(observations.observations(_rows(spark, d, _SMALL)), 3, save=False)["patterns"]


def cumulative_summary(spark, d):
    """Counters of the same merge."""
    out = observations.merged(observations.observations(_rows(spark, d, _SMALL)), 3, save=False)["summary"]
    return out.select("dataset", "observation_count", "null_key_hold_count", "canonical_count", "multi_variant_key_count", "observed_variant_count", "exact_repeat_count", "explicit_null")


def cumulative_race(spark, d):
    """The race predictions of all snapshots: extracted, merged, and put through the plan of the dataset."""
    found = observations.merged(observations.observations(_rows(spark, d, ["race"])), 3)["canonical"]
    source = found.select(F.col("canonical_key").alias("provenance_path"), F.col("raw_record").alias("record"), F.lit("race_prediction").alias("family"))
    return datasets.daily(source, "race_prediction_daily").excluded.groupBy("exclusion_reason").agg(F.count("*").alias("row_count"))


def _object_rows(name: str, skip: tuple[str, ...] = (), **computed: str) -> str:
    """Rows ``k, d, i, parent, record`` and the fields of a family; ``skip`` names fields that aren't kept."""
    _, rows, fields = OBJECTS[name]
    kept = [f"CASE WHEN {c} IS NOT NULL THEN '\"{n}\":' || {c} END" for n, c in ({n: f'"{n}"' for n in fields if n not in skip} | computed).items()]
    cells = ", ".join(f'{e} AS "{n}"' for n, e in fields.items())
    return f"(SELECT *, '{{' || array_to_string(list_sort(list_filter([{', '.join(kept)}], lambda x: x IS NOT NULL)), ',') || '}}' AS record FROM (SELECT *, {_DAY} AS day, {cells} FROM ({rows}) b, (SELECT unnest([1, 2, 3]) AS i) s WHERE {_IN}) f)"


def _sql(rows: str, dataset: str, key: str, place: str = "k::VARCHAR") -> str:
    return f"SELECT '{dataset}' AS dataset, {key} AS canonical_key, 's' || i AS snapshot_id, {place} AS source_record_index, record FROM {rows} o"


def _sha(dataset: str, json: str) -> str:
    return f"'{dataset}:' || sha256({json})"


_DATED = "coalesce('\"' || day || '\"', \"calendarDate\")"
_ON = "'[\"' || day || '\",\"' || "
_UDS_DAY = "CASE WHEN day IS NOT NULL THEN day WHEN k % 29 = 1 AND k % 2 = 0 THEN d END"
_VO2 = "CASE k % 5 WHEN 0 THEN CASE WHEN \"observationTimestamp\" IS NOT NULL THEN d || 'T11:00:00' END WHEN 1 THEN NULL ELSE d || 'T10:00:00Z' END"
_META = "CASE WHEN k % 4 = 1 THEN '{\"calendarDate\":\"' || d || '\",\"sequence\":' || (k % 3) || '}' END"

EXTRACTED = {
    "activities": _sql(_object_rows("activities"), "activities", "CASE WHEN k % 7 > 2 THEN 'garmin_activity:' || k WHEN k % 7 = 2 THEN 'garmin_activity:a' || k WHEN k % 14 <> 7 THEN 'garmin_activity_hash:' || substr(sha256('[' || (k * 1000) || ',' || (k % 5) || '.5,null,\"run\"]'), 1, 24) END"),
    "gear": _sql(_object_rows("gear"), "gear", f"CASE WHEN k % 4 > 1 THEN {_sha('gear', chr(39) + '[' + chr(39) + ' || k || ' + chr(39) + ']' + chr(39))} WHEN k % 8 <> 0 THEN 'gear:' || sha256('[\"garmin_gear_hash:' || substr(sha256('[\"u' || k || '\",' || coalesce(\"displayName\", 'null') || ',null]'), 1, 24) || '\"]') END"),
    "links": _sql(_object_rows("links"), "activity_gear", "CASE WHEN k % 11 <> 0 THEN 'activity_gear:' || sha256('[\"' || parent || '\",' || k || ']') END", "'0:' || parent || ':' || k"),
    "personal_records": _sql(_object_rows("personal_records"), "personal_records", "CASE WHEN k % 5 > 2 THEN 'personal_records:' || sha256('[' || k || ']') WHEN k % 5 = 0 THEN 'personal_records:' || sha256('[\"garmin_personal_record_hash:' || substr(sha256('[' || (k % 9) || ',\"Fastest 1 km\",' || k || ',null]'), 1, 24) || '\"]') END"),
    "hill": _sql(_object_rows("hill", ("deviceId", "calendarDate"), calendarDate=_DATED), "hill_score_daily", "'hill_score_daily:' || sha256('[\"' || day || '\"]')"),
    "race": _sql(_object_rows("race", ("userProfilePK", "calendarDate"), calendarDate=_DATED), "race_prediction_daily", f"CASE WHEN k % 13 <> 0 THEN 'race_prediction_daily:' || sha256({_ON}d || 'T01:30:00\"]') END"),
    "sleep": _sql(_object_rows("sleep", ("retro", "calendarDate"), calendarDate=_DATED), "sleep_daily", "'sleep_daily:' || sha256('[\"' || day || '\"]')"),
    "uds": _sql(_object_rows("uds", ("uuid", "calendarDate"), calendarDate=f"coalesce('\"' || {_UDS_DAY} || '\"', \"calendarDate\")"), "uds_daily", f"'uds_daily:' || sha256('[\"' || {_UDS_DAY} || '\"]')"),
    "vo2max": _sql(_object_rows("vo2max", ("deviceId", "calendarDate"), calendarDate=_DATED, vo2MaxSourceSeries="'\"activity_vo2max_daily\"'"), "vo2max_daily", f"CASE WHEN k % 7 > 1 THEN 'vo2max_daily:' || sha256({_ON}'activity_vo2max_daily\",\"RUNNING\",\"' || {_VO2} || '\"]') END"),
    "lactate": _sql(_object_rows("lactate", ("weight", "metaData"), metaData=_META), "lactate_threshold_candidates", "'lactate_threshold_candidates:' || sha256('[\"history\",\"' || replace(record, '\"', '\\\"') || '\"]')") + " WHERE k % 3 <> 0 OR k % 6 = 0",
}

_ALL = " UNION ALL ".join(EXTRACTED[n] for n in _SMALL)
_KEYS = f"""x AS ({_ALL}), g AS (SELECT *, dataset IN ('hill_score_daily', 'race_prediction_daily', 'uds_daily', 'vo2max_daily') AS daily, dataset = 'uds_daily' AS kept FROM x),
    s AS (SELECT dataset, canonical_key, snapshot_id, min(record) <> max(record) AS two FROM g WHERE canonical_key IS NOT NULL GROUP BY ALL),
    k AS (SELECT dataset, canonical_key, any_value(daily) AS daily, any_value(kept) AS kept, count(DISTINCT record) AS records, count(*) AS n, count(DISTINCT snapshot_id) AS snaps, (max((snapshot_id = 's1')::INT)::VARCHAR || max((snapshot_id = 's2')::INT) || max((snapshot_id = 's3')::INT)) AS pattern FROM g WHERE canonical_key IS NOT NULL GROUP BY ALL),
    v AS (SELECT *, CASE WHEN (dataset, canonical_key) IN (SELECT (dataset, canonical_key) FROM s WHERE two) THEN 'stop' WHEN NOT daily OR records = 1 THEN 'merged' WHEN kept THEN 'variants' ELSE 'stop' END AS outcome FROM k)"""

SQL = {f"extract_{name}": sql for name, sql in EXTRACTED.items()} | {
    "cumulative_patterns": f"WITH {_KEYS} SELECT dataset, pattern AS presence_pattern, count(*)::BIGINT AS key_count FROM v WHERE outcome = 'merged' GROUP BY ALL",
    "cumulative_summary": f"""WITH {_KEYS}, o AS (SELECT dataset, count(*)::BIGINT AS observation_count, count(*) FILTER (WHERE canonical_key IS NULL)::BIGINT AS null_key_hold_count FROM g GROUP BY 1),
        q AS (SELECT g.dataset, sum((length(record) - length(replace(record, ':null', ''))) // 5)::BIGINT AS explicit_null FROM g JOIN v USING (dataset, canonical_key) WHERE outcome = 'merged' GROUP BY 1),
        t AS (SELECT dataset, count(*) FILTER (WHERE outcome = 'merged')::BIGINT AS canonical_count, count(*) FILTER (WHERE outcome = 'variants')::BIGINT AS multi_variant_key_count, coalesce(sum(records) FILTER (WHERE outcome = 'variants' OR outcome = 'merged' AND records = 1), 0)::BIGINT AS observed_variant_count,
              coalesce(sum(n - records) FILTER (WHERE outcome = 'variants' OR outcome = 'merged' AND records = 1), 0)::BIGINT AS exact_repeat_count FROM v GROUP BY 1)
        SELECT * FROM o JOIN t USING (dataset) JOIN q USING (dataset)""",
    "cumulative_race": f"""WITH x AS ({EXTRACTED['race']}) SELECT 'missing_or_invalid_race_prediction' AS exclusion_reason, count(DISTINCT canonical_key)::BIGINT AS row_count FROM x WHERE canonical_key IS NOT NULL HAVING row_count > 0""",
}

QUERIES = {f"extract_{name}": _extracted(name) for name in EXTRACTED} | {"cumulative_patterns": cumulative_patterns, "cumulative_summary": cumulative_summary, "cumulative_race": cumulative_race}
