"""Observations of all datasets in the files of any number of exports: what a merge over snapshots reads.

A reader takes each JSON file once and returns its objects with their place in it. All else is columns: which dataset an
object belongs to, which of its fields are kept (a field that is there with null stays there), its date, and its key.
A row without a key stays, with null for the key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelake.functions import coerce, times
from pacelake.operators import snapshot, stage
from pacelake.sources import wrappers


@dataclass(frozen=True)
class Source:
    """Files whose lower-cased names match, and what is read from them. Without ``fields`` all are kept."""

    name: str
    how: str  # ends, starts or holds
    reader: str
    dataset: str
    fields: tuple[str, ...] = ()
    series: str | None = None


_VO2MAX = ("calendarDate", "vo2MaxValue", "sport", "maxMet", "maxMetCategory", "calibratedData", "vo2MaxSourceSeries")
_LACTATE = ("lactateThresholdSpeed", "lactateThresholdHeartRate", "functionalThresholdPower")

# Names of files in the order they are tried, and the fields that observations keep of each.
SOURCES = [
    Source("summarizedactivities.json", "ends", "activities", "activities"),
    Source("gear.json", "ends", "gear", "gear"),
    Source("personalrecord.json", "ends", "personal", "personal_records"),
    Source("hillscore", "starts", "objects", "hill_score_daily", ("calendarDate", "overallScore", "strengthScore", "enduranceScore", "hillScoreClassificationId", "hillScoreFeedbackPhraseId")),
    Source("endurancescore", "starts", "objects", "endurance_score_daily", ("calendarDate", "overallScore", "classification", "feedbackPhrase")),
    Source("runracepredictions", "holds", "daily", "race_prediction_daily", ("calendarDate", "timestamp", "raceTime5K", "raceTime10K", "raceTimeHalf", "raceTimeMarathon")),
    Source("sleepdata.json", "holds", "daily", "sleep_daily", ("calendarDate", "sleepStartTimestampGMT", "sleepEndTimestampGMT", "sleepTimeSeconds", "totalSleepSeconds", "deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds", "sleepScores")),
    Source("udsfile", "holds", "daily", "uds_daily", ("calendarDate", "date", "totalSteps", "steps", "totalDistanceMeters", "distanceMeters", "activeKilocalories", "bmrKilocalories", "restingHeartRate", "minHeartRate", "maxHeartRate", "bodyBattery", "allDayStress", "bodyBatteryFeedback")),
    Source("metricsacutetrainingload", "holds", "daily", "acute_training_load_daily", ("calendarDate", "acwrPercent", "acwrStatus", "dailyTrainingLoadAcute", "dailyTrainingLoadChronic", "dailyAcuteChronicWorkloadRatio", "timestamp")),
    Source("trainingreadinessdto", "holds", "daily", "training_readiness_daily", ("calendarDate", "score", "level", "recoveryTime", "acwrFactorPercent", "stressHistoryFactorPercent", "hrvFactorPercent", "sleepHistoryFactorPercent", "acuteLoad", "hrvWeeklyAverage", "validSleep", "sleepScore", "timestamp")),
    Source("activityvo2max", "holds", "daily", "vo2max_daily", (*_VO2MAX, "timestampGmt", "observationTimestamp", "activityId"), "activity_vo2max_daily"),
    Source("metricsmaxmetdata", "holds", "daily", "vo2max_daily", (*_VO2MAX, "updateTimestamp", "observationTimestamp"), "performance_metrics_daily"),
    Source("snapshot_vo2max", "holds", "daily", "vo2max_daily", (*_VO2MAX, "timestampGmt", "updateTimestamp", "observationTimestamp", "activityId")),
    Source("traininghistory", "holds", "daily", "training_history_daily", ("calendarDate", "timestamp", "trainingStatus", "sport")),
    Source("userbiometrics.json", "ends", "objects", "lactate_threshold_candidates", (*_LACTATE, "metaData"), "history"),
    Source("biometrics_latest.json", "ends", "objects", "lactate_threshold_candidates", _LACTATE, "latest_snapshot"),
    Source("userbiometricprofiledata.json", "ends", "objects", "lactate_threshold_candidates", _LACTATE, "profile_state"),
    Source("heartratezones.json", "ends", "objects", "lactate_threshold_candidates", (*_LACTATE, "trainingMethod"), "derived_evidence"),
]

# Datasets of which different records under one key stop a merge, those that keep them as variants instead, and those keyed by the time of observation too.
DAILY = ["hill_score_daily", "endurance_score_daily", "race_prediction_daily", "sleep_daily", "uds_daily", "acute_training_load_daily", "training_readiness_daily", "vo2max_daily", "training_history_daily"]
PRESERVED = ["endurance_score_daily", "uds_daily"]
TIMED = ["race_prediction_daily", "acute_training_load_daily", "training_readiness_daily", "training_history_daily"]

SNAPSHOT = ["snapshot_id", "logical_order", "export_observed_at"]


def source_index(path: Column) -> Column:
    """The place in ``SOURCES`` of the first source that a path belongs to, null if none. Suffixes are those of the whole path, all else of its last name."""
    lower = F.lower(path)
    base = F.regexp_extract(lower, r"([^/!]*)$", 1)
    out = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(SOURCES))):
        hit = (lower if s.reader in ("activities", "gear", "personal") else base).endswith(s.name) if s.how == "ends" else base.startswith(s.name) if s.how == "starts" else base.contains(s.name)
        out = F.when(hit, k).otherwise(out)
    return out


def _objects(value: object) -> list[dict]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def _listed(tops: list[dict], name: str) -> Iterator[tuple[str, None, dict]]:
    for c, top in enumerate(tops):
        rows = top.get(name)
        for k, row in enumerate(_objects(rows) if isinstance(rows, list) else []):
            yield f"{c}:{k}", None, row


def read_objects(reader: str, value: object) -> Iterator[tuple[str, str | None, dict]]:
    """(place in the file, gear of a link, object) of all objects of a file."""
    if reader == "gear":
        tops = _objects(value)
        yield from _listed(tops, "gearDTOS")
        for c, top in enumerate(tops):
            links = top.get("gearActivityDTOs")
            for gear in sorted(links) if isinstance(links, dict) else []:
                for k, row in enumerate(_objects(links[gear]) if isinstance(links[gear], list) else []):
                    yield f"{c}:{gear}:{k}", gear, {**row, "gearPk": gear}
    elif reader == "personal":
        yield from _listed(_objects(value), "personalRecords")
    else:
        rows = wrappers.activities(value) if reader == "activities" else wrappers.unwrap(value, wrappers.WRAPPERS["daily"]) if reader == "daily" else _objects(value)
        for k, row in enumerate(rows):
            yield str(k), None, row


_ROWS = "source int, source_relative_path string, source_object_sha256 string, source_record_index string, parent string, record map<string,string>, snapshot_id string, logical_order long, export_observed_at string"


def source_rows(assets: DataFrame) -> DataFrame:
    """A row for each object of each JSON file that is a source; ``assets`` are those of ``sources.assets`` with the columns ``SNAPSHOT``. A file that isn't JSON fails the job."""
    readers = [s.reader for s in SOURCES]
    columns = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                held = []
                for place, parent, row in read_objects(readers[f.source], json.loads(bytes(f.data).decode("utf-8-sig"))):
                    held.append((f.source, f.path, f.sha256, place, parent, {n: wrappers.canonical(v) for n, v in row.items()}, f.snapshot_id, f.logical_order, f.export_observed_at))
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    path = F.coalesce("member_path", "source_path")
    mine = assets.where("kind = 'json'").withColumn("source", source_index(path)).where("source IS NOT NULL")
    return mine.select("source", path.alias("path"), "sha256", "data", F.col("snapshot_id").cast("string"), F.col("logical_order").cast("long"), F.col("export_observed_at").cast("string")).mapInPandas(run, _ROWS)


def _of(values: dict[int, object], kind: str) -> Column:
    """A value for each source."""
    return F.element_at(F.array(*[F.lit(values.get(k)).cast(kind) for k in range(len(SOURCES))]), F.col("source") + 1)


def _r(name: str) -> Column:
    return F.col("record")[name]


def _s(name: str) -> Column:
    return F.col("source_record")[name]


def _there(json_: Column) -> Column:
    """Neither absent nor null nor the empty text."""
    return F.coalesce(~json_.isin("null", '""'), F.lit(False))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _list(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(p, F.lit("null")) for p in parts]), F.lit("]"))


def _hashed(prefix: str, parts: list[Column]) -> Column:
    """24 hex digits of the hash of fallback parts, quoted; null if none of them is there."""
    some = F.lit(False)
    for p in parts:
        some = some | _there(p)
    return F.when(some, F.concat(F.lit('"' + prefix), F.substring(F.sha2(_list(parts), 256), 1, 24), F.lit('"')))


def _unquoted(json_: Column) -> Column:
    return F.coalesce(coerce.text(json_), json_)


def observations(rows: DataFrame) -> DataFrame:
    """The observations of all datasets, from rows of ``source_rows``: ``dataset, canonical_key, record`` and where they are from.

    Keys: activities by their id, else by a hash of start, distance, duration and type; gear and personal records by their id, else by a hash of what describes them;
    links by gear and activity; daily datasets by date, of those in ``TIMED`` and of ``vo2max_daily`` by time of observation as well, the latter by series and sport too;
    threshold candidates by family and content. Zero is a value. A key with a part that is null or empty is null.
    """
    link = F.col("parent").isNotNull()
    base = _of({k: s.dataset for k, s in enumerate(SOURCES)}, "string")
    fields = F.element_at(F.array(*[F.array(*map(F.lit, s.fields)) if s.fields else F.lit(None).cast("array<string>") for s in SOURCES]), F.col("source") + 1)
    rows = rows.withColumns({"dataset": F.when(link, "activity_gear").otherwise(base), "series": _of({k: s.series for k, s in enumerate(SOURCES)}, "string"), "allowed": fields})

    lactate, daily, vo2max, timed = F.col("dataset") == "lactate_threshold_candidates", F.col("dataset").isin(DAILY), F.col("dataset") == "vo2max_daily", F.col("dataset").isin(TIMED)
    # of the metadata of a threshold candidate two fields are kept; anything but an object is left out
    parts = F.create_map(F.lit("calendarDate"), coerce.field(_r("metaData"), "calendarDate"), F.lit("sequence"), coerce.field(_r("metaData"), "sequence"))
    meta = F.when(lactate & (F.col("series") == "history") & coerce.is_object(_r("metaData")), snapshot.stable_json(F.map_filter(parts, lambda _, v: v.isNotNull())))
    stated = _r("calendarDate")
    empty = ~_there(stated) | F.coalesce(stated.isin("0", "0.0", "false", "[]", "{}"), F.lit(False))
    label = F.when(daily, F.when((F.col("dataset") == "uds_daily") & empty, _r("date")).otherwise(stated))
    own = F.when(vo2max, F.coalesce(_quoted(F.col("series")), _r("vo2MaxSourceSeries")))
    rows = rows.withColumns({"meta": meta, "label": label, "own": own})
    by_activity = vo2max & (F.col("own") == '"activity_vo2max_daily"')
    first = F.when(timed, _r("timestamp")).when(by_activity, _r("timestampGmt")).when(vo2max, _r("updateTimestamp"))
    rows = rows.withColumns({"day": F.when(F.col("label").isNotNull(), times.bound(F.col("label"), times.date_label)), "first": first, "second": F.when(vo2max, _r("observationTimestamp"))})
    # the other field counts only where the first is not there
    chosen, named_utc = F.when(_there(F.col("first")), F.col("first")).otherwise(F.col("second")), by_activity & _there(F.col("first"))
    rows = rows.withColumns({"chosen": chosen, "named_utc": F.coalesce(named_utc, F.lit(False))})
    rows = rows.withColumn("moment", F.when(F.col("chosen").isNotNull(), times.moment(F.col("chosen"), F.col("named_utc"))))

    new = F.map_filter(F.create_map(F.lit("calendarDate"), _quoted(F.col("day")), F.lit("metaData"), F.col("meta"), F.lit("vo2MaxSourceSeries"), F.when(vo2max & ~F.map_contains_key("record", "vo2MaxSourceSeries"), F.col("own"))), lambda _, v: v.isNotNull())
    # records of which all fields are kept and none is added stay as they are
    as_is = F.col("allowed").isNull() & ~daily & ~lactate
    rows = rows.withColumn("new", F.when(as_is, None).otherwise(new))
    kept = F.map_filter("record", lambda n, _: (F.col("allowed").isNull() | F.array_contains("allowed", n)) & ~F.map_contains_key("new", n) & ~(lactate & (n == "metaData")))
    rows = rows.withColumn("source_record", F.col("record")).withColumn("record", F.when(as_is, F.col("record")).otherwise(F.map_concat(kept, "new")))
    rows = rows.where(~lactate | F.exists(F.map_keys("record"), lambda n: n != "metaData"))

    start = F.when(F.coalesce(_s("startTimeGmt") != "null", F.lit(False)), _s("startTimeGmt")).otherwise(_s("beginTimestamp"))
    activity = F.when(_there(_s("activityId")), F.concat(F.lit("garmin_activity:"), _unquoted(_s("activityId")))).otherwise(F.replace(_hashed("garmin_activity_hash:", [start, _s("distance"), _s("duration"), _s("activityType")]), F.lit('"'), F.lit("")))
    gear = F.when(_there(_s("gearPk")), _s("gearPk")).otherwise(_hashed("garmin_gear_hash:", [_s("uuid"), _s("displayName"), _s("dateBegin")]))
    record_id = _s("personalRecordId")
    personal = F.when(_there(record_id), F.when(coerce.is_text(record_id) | record_id.rlike(r"^-?\d+$"), record_id)).otherwise(_hashed("garmin_personal_record_hash:", [_s("activityId"), _s("personalRecordType"), _s("value"), _s("prStartTimeGMT")]))
    json_key = (
        F.when(F.col("dataset") == "gear", _list([gear])).when(F.col("dataset") == "personal_records", _list([personal]))
        .when(link, F.when((F.col("parent") != "") & _there(_s("activityId")), _list([_quoted(F.col("parent")), _s("activityId")])))
        .when(lactate, _list([_quoted(F.col("series")), _quoted(snapshot.stable_json(F.col("record")))]))
        .when(vo2max, F.when(F.col("day").isNotNull() & _there(F.col("own")) & _there(_s("sport")) & F.col("moment").isNotNull(), _list([_quoted(F.col("day")), F.col("own"), _s("sport"), _quoted(F.col("moment"))])))
        .when(timed, F.when(F.col("day").isNotNull() & F.col("moment").isNotNull(), _list([_quoted(F.col("day")), _quoted(F.col("moment"))])))
        .when(daily, F.when(F.col("day").isNotNull(), _list([_quoted(F.col("day"))])))
    )
    missing = (F.col("dataset") == "gear") & gear.isNull() | (F.col("dataset") == "personal_records") & personal.isNull()
    rows = rows.withColumn("key_json", F.when(~F.coalesce(missing, F.lit(False)), json_key))
    key = F.when(F.col("dataset") == "activities", activity).otherwise(F.concat("dataset", F.lit(":"), F.sha2("key_json", 256)))
    return rows.select("dataset", key.alias("canonical_key"), *SNAPSHOT, "source_relative_path", "source_object_sha256", "source_record_index", "record")


def file_states(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """``snapshot_id, parser_state, file_count``: files from which something was read, and files that no reader takes or that hold nothing for it."""
    path = F.coalesce("member_path", "source_path")
    files = assets.select("snapshot_id", path.alias("source_relative_path"), "kind")
    read = rows.select("snapshot_id", "source_relative_path").distinct().withColumn("read", F.lit(True))
    state = F.when((F.col("kind") == "fit") | F.col("read"), "explicit_value").otherwise("parser_unsupported")
    return files.join(read, ["snapshot_id", "source_relative_path"], "left").groupBy("snapshot_id", state.alias("parser_state")).agg(F.count("*").alias("file_count"))


def merged(found: DataFrame, snapshots: int, save: bool = True) -> dict[str, DataFrame]:
    """The merge of all datasets, each by its own rules. The observations are saved first, since several tables are made of them, unless one is wanted that reads them once."""
    return snapshot.merge_observations(stage.saved(found) if save else found, snapshots, F.col("dataset").isin(DAILY), F.col("dataset").isin(PRESERVED))
