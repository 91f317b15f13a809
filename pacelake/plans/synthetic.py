"""Queries over an export that is made here: visibly invented files, in memory, read by the library's own sources."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.plans import datasets
from pacelake.sources import assets, fit

#: 2030-01-01T00:00:00Z, in milliseconds, and in seconds of binary activity files.
START_MS = 1_893_456_000_000
START_FIT = START_MS // 1000 - 631_065_600
DAY_MS = 86_400_000


def _u32(field: int, value: int) -> tuple[int, int, int, bytes]:
    return field, 4, 0x86, struct.pack("<I", value)


def _u16(field: int, value: int) -> tuple[int, int, int, bytes]:
    return field, 2, 0x84, struct.pack("<H", value)


def _u8(field: int, value: int) -> tuple[int, int, int, bytes]:
    return field, 1, 0x02, bytes([value])


def activity_file(start: int = START_FIT, laps: int = 2, header: int = 14) -> bytes:
    """A binary file of one run with laps of 1 km, an invalid power and two heart-rate-variability messages."""
    rows = [(fit.HRV_STATUS, [_u16(1, 128 * (40 + k)), _u32(253, start + k)]) for k in range(2)]
    rows += [(19, [_u32(2, start + 300 * k), _u32(7, 300_000), _u32(8, 300_000), _u32(9, 100_000), _u8(15, 140 + k), _u32(253, start + 300 * (k + 1))]) for k in range(laps)]
    rows.append((18, [_u32(2, start), _u8(5, 1), _u8(6, 0), _u32(7, 300_000 * laps), _u32(8, 300_000 * laps), _u32(9, 100_000 * laps), _u8(16, 145), _u16(20, 0xFFFF), _u16(26, laps), _u32(253, start + 300 * laps)]))
    return fit.encode(rows, header)


def export_files(activities: int = 3) -> list[tuple[str, bytes]]:
    """(path, content) of a small export: activities, gear, records, daily metrics, binary files, an archive and a stray file."""
    listed = [
        {"activityId": 1000 + k, "name": f"SYNTHETIC-{k}", "activityType": "running", "sportType": "RUNNING", "startTimeGmt": START_MS + k * DAY_MS, "distance": 200_000 if k else 500_000, "duration": 600_000, "elapsedDuration": 600_000, "avgHr": None if k == 2 else 140, "lapCount": 2}
        for k in range(activities)
    ]
    gear = {"gearDTOS": [{"gearPk": 7, "uuid": "SYNTHETIC-GEAR", "displayName": "Shoe"}], "gearActivityDTOs": {"7": [{"activityId": 1000}, {"activityId": 9999}]}}
    records = {"personalRecords": [{"personalRecordId": 1, "activityId": 1000, "personalRecordType": "best", "value": 1.0}, {"personalRecordId": 2, "activityId": 0, "personalRecordType": "steps", "value": 2.0}]}
    day = lambda k: f"2030-01-{k + 1:02d}"
    races = [{"calendarDate": day(k), "timestamp": f"{day(k)}T01:00:00.0", "raceTime5K": 1500 - k, "raceTime10K": 3100, "raceTimeHalf": 7000, "raceTimeMarathon": 0 if k == 2 else 15000} for k in range(3)]
    uds = [{"calendarDate": day(k), "totalSteps": 1000 * k, "allDayStress": {"aggregatorList": [{"type": "AWAKE", "averageStressLevel": 9}, {"type": "total", "averageStressLevel": 30}]}} for k in range(3)]
    sleep = [{"calendarDate": day(k), "sleepStartTimestampGMT": f"{day(k)}T13:00:00.0", "sleepEndTimestampGMT": f"{day(k)}T21:00:00.0", "deepSleepSeconds": 3600, "lightSleepSeconds": 7200, "remSleepSeconds": None} for k in range(2)]
    hill = [{"calendarDate": day(0), "overallScore": 50, "deviceId": 1}, {"calendarDate": day(0), "overallScore": 50, "deviceId": 1}, {"calendarDate": day(1), "overallScore": "50"}]
    files: list[tuple[str, object]] = [
        ("DI/0_summarizedActivities.json", [{"summarizedActivitiesExport": listed}]), ("DI/gear.json", [gear]), ("DI/personalRecord.json", [records]), ("DI/RunRacePredictions_1.json", races),
        ("DI/UDSFile_1.json", uds), ("DI/1_sleepData.json", sleep), ("DI/HillScore_1.json", hill), ("DI/unknown.json", {"a": 1}),
    ]
    out = [(path, json.dumps(value).encode()) for path, value in files]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.fit", activity_file())
        z.writestr("b.fit", activity_file(START_FIT + 86_400, header=12))
        z.writestr("__MACOSX/c.fit", b"junk")
        z.writestr("notes.txt", "skipped")
    good = activity_file(START_FIT + 2 * 86_400)
    return [*out, ("DI/parts.zip", packed.getvalue()), ("DI/copy.fit", activity_file()), ("DI/c.fit", good), ("DI/short.fit", b"not-fit"), ("DI/cut.fit", good[:-3]), ("DI/two.fit", good + good), ("DI/bad.fit", good[:-1] + bytes([good[-1] ^ 1])), ("DI/readme.md", b"skipped")]


def export_assets(spark: SparkSession, activities: int = 3) -> DataFrame:
    rows = [(path, len(data), data) for path, data in export_files(activities)]
    return assets.assets_of(spark.createDataFrame(rows, "source_path string, size_bytes long, data binary"))


def fit_decode(spark: SparkSession, d: str) -> DataFrame:
    """Status, sessions, laps and aliases of every distinct binary file."""
    found = fit.decoded(export_assets(spark))
    return found.select("source_path", "alias_count", "status", F.size("sessions").alias("session_count"), F.aggregate("sessions", F.lit(0), lambda n, s: n + F.size(s["laps"])).alias("lap_count"), "records", "sentinels")


def zip_intake(spark: SparkSession, d: str) -> DataFrame:
    """Every asset with its place and family."""
    return export_assets(spark).select("kind", "source_path", "member_path", "provenance_path", "size_bytes", "sha256", "family")


def activities_golden(spark: SparkSession, d: str) -> DataFrame:
    return datasets.activities(export_assets(spark)).select("garmin_activity_key", "activity_id", "activity_datetime_local", "activity_date_local", "distance_m", "duration_sec", "avg_hr", "lap_count")


def run_all_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each normalized dataset of the export."""
    found, _ = datasets.normalize(spark, export_assets(spark))
    each = [df.agg(F.count("*").cast("long").alias("row_count")).select(F.lit(name).alias("dataset"), "row_count") for name, df in found.items()]
    out = each[0]
    for df in each[1:]:
        out = out.union(df)
    return out
