"""Scans of folders and archives by ranges, and the observations of exports that they find."""

import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pacelake.functions import times
from pacelake.sources import assets, observations


def sha(*parts):
    return hashlib.sha256(json.dumps(list(parts), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


EXPORTS = {
    "s1": {
        "DI/x_summarizedActivities.json": [{"summarizedActivitiesExport": [{"activityId": 7, "name": None}, {"beginTimestamp": 5, "activityType": "run"}, {"name": "no key"}]}],
        "DI/gear.json": [{"gearDTOS": [{"gearPk": 3, "uuid": "u"}, {"uuid": "w"}], "gearActivityDTOs": {"9": [{"activityId": 7}], "10": [{"activityId": None}]}}],
        "DI/UDSFile_1.json": {"data": [{"calendarDate": "", "date": "2024-01-02T00:00:00", "steps": 0, "uuid": "x"}, {"calendarDate": 1704067200000, "totalSteps": None}]},
        "DI/MetricsMaxMetData_1.json": [{"calendarDate": "2024-01-03", "updateTimestamp": "2024-01-03 10:00:00.0", "sport": "RUNNING", "vo2MaxValue": 50.5}],
        "DI/ActivityVo2Max_1.json": [{"calendarDate": "2024-01-03", "timestampGmt": "2024-01-03T10:00:00", "sport": "RUNNING"}],
        "DI/TrainingHistory_1.json": [{"calendarDate": "2024-01-03", "timestamp": "2024-01-03T10:00:00+09:00", "trainingStatus": "x", "secret": 1}],
        "DI/userBioMetrics.json": [{"functionalThresholdPower": 200, "metaData": {"calendarDate": "2024-01-01", "sequence": 2, "x": 1}}, {"weight": 70}],
        "DI/notes.txt": "text",
        "DI/unknown.json": {"a": 1},
    },
    "s2": {"DI/x_summarizedActivities.json": [{"summarizedActivitiesExport": [{"activityId": 7, "name": "run"}]}], "DI/HillScore_1.json": [{"calendarDate": "20240105", "overallScore": 3, "deviceId": 1}]},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for name, files in EXPORTS.items():
        os.makedirs(root / name / "DI")
        with zipfile.ZipFile(root / name / "part.zip", "w") as archive:
            for path, value in files.items():
                data = value if isinstance(value, str) else json.dumps(value)
                if path.endswith("_1.json"):
                    archive.writestr(path, data)
                else:
                    (root / name / path).write_text(data)
            archive.writestr("__MACOSX/._x.json", "junk")
    return str(root)


def expected(root):
    out = set()
    for where, _, names in os.walk(root):
        for n in names:
            path = os.path.join(where, n)
            relative = os.path.relpath(path, root)
            data = open(path, "rb").read()
            out.add((relative, len(data), hashlib.sha256(data).hexdigest()))
            if n.endswith(".zip"):
                with zipfile.ZipFile(path) as z:
                    out |= {(f"{relative}!{i.filename}", i.file_size, hashlib.sha256(z.read(i)).hexdigest()) for i in z.infolist() if "__MACOSX" not in i.filename}
    return out


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_inventory_by_ranges(spark, folder, limit):
    found = assets.scan(spark, folder, range_bytes=limit)
    assert {(r["relative_path"], r["size_bytes"], r["sha256"]) for r in found.collect()} == expected(folder)
    tasks = found.rdd.getNumPartitions()
    assert tasks == (len(expected(folder)) if limit == 1 else tasks) and (limit > 1000 or tasks > 4)


def test_a_file_that_changes_fails_the_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c.json", "{}")
    for name in ("a.json", "b.zip"):
        found = assets.scan(spark, str(tmp_path))
        reader = assets.ScanReader(str(tmp_path), 1 << 20, False, assets.Limits())
        parts = reader.partitions()
        with open(tmp_path / name, "ab") as f:
            f.write(b" ")
        with pytest.raises(assets.IntakeError, match="changed_during_scan"):
            [row for p in parts for row in reader.read(p)]
        assert found.count() == 3  # a new scan lists anew


def test_unsafe_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="INPUT_EMPTY"):
        assets.scan(spark, str(tmp_path)).collect()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../c.json", "{}")
    with pytest.raises(Exception, match="path_traversal"):
        assets.scan(spark, str(tmp_path)).collect()
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="malformed_archive"):
        assets.scan(spark, str(tmp_path)).collect()


@pytest.fixture(scope="module")
def found(spark, folder):
    parts = []
    for n, name in enumerate(sorted(EXPORTS), 1):
        a = assets.assets_of_scan(assets.scan(spark, f"{folder}/{name}", content=True))
        parts.append(a.withColumns({"snapshot_id": F.lit(name), "logical_order": F.lit(n).cast("long"), "export_observed_at": F.lit(f"2024-0{n}-01")}))
    files = parts[0].union(parts[1])
    rows = observations.source_rows(files).cache()
    return files, rows, observations.observations(rows).cache()


def test_observations_of_files(found):
    got = {(r["dataset"], r["canonical_key"], r["snapshot_id"], r["source_record_index"], tuple(sorted(r["record"].items()))) for r in found[2].collect()}
    run = hashlib.sha256(b'[5,null,null,"run"]').hexdigest()[:24]
    want = {
        ("activities", "garmin_activity:7", "s1", "0", (("activityId", "7"), ("name", "null"))),
        ("activities", f"garmin_activity_hash:{run}", "s1", "1", (("activityType", '"run"'), ("beginTimestamp", "5"))),
        ("activities", None, "s1", "2", (("name", '"no key"'),)),
        ("activities", "garmin_activity:7", "s2", "0", (("activityId", "7"), ("name", '"run"'))),
        ("gear", "gear:" + sha(3), "s1", "0:0", (("gearPk", "3"), ("uuid", '"u"'))),
        ("gear", "gear:" + sha("garmin_gear_hash:" + sha("w", None, None)[:24]), "s1", "0:1", (("uuid", '"w"'),)),
        ("activity_gear", "activity_gear:" + sha("9", 7), "s1", "0:9:0", (("activityId", "7"), ("gearPk", '"9"'))),
        ("activity_gear", None, "s1", "0:10:0", (("activityId", "null"), ("gearPk", '"10"'))),
        ("uds_daily", "uds_daily:" + sha("2024-01-02"), "s1", "0", (("calendarDate", '"2024-01-02"'), ("date", '"2024-01-02T00:00:00"'), ("steps", "0"))),
        ("uds_daily", "uds_daily:" + sha("2024-01-01"), "s1", "1", (("calendarDate", '"2024-01-01"'), ("totalSteps", "null"))),
        ("vo2max_daily", "vo2max_daily:" + sha("2024-01-03", "performance_metrics_daily", "RUNNING", "2024-01-03T10:00:00"), "s1", "0", (("calendarDate", '"2024-01-03"'), ("sport", '"RUNNING"'), ("updateTimestamp", '"2024-01-03 10:00:00.0"'), ("vo2MaxSourceSeries", '"performance_metrics_daily"'), ("vo2MaxValue", "50.5"))),
        ("vo2max_daily", "vo2max_daily:" + sha("2024-01-03", "activity_vo2max_daily", "RUNNING", "2024-01-03T10:00:00Z"), "s1", "0", (("calendarDate", '"2024-01-03"'), ("sport", '"RUNNING"'), ("timestampGmt", '"2024-01-03T10:00:00"'), ("vo2MaxSourceSeries", '"activity_vo2max_daily"'))),
        ("training_history_daily", "training_history_daily:" + sha("2024-01-03", "2024-01-03T01:00:00Z"), "s1", "0", (("calendarDate", '"2024-01-03"'), ("timestamp", '"2024-01-03T10:00:00+09:00"'), ("trainingStatus", '"x"'))),
        ("lactate_threshold_candidates", "lactate_threshold_candidates:" + sha("history", '{"functionalThresholdPower":200,"metaData":{"calendarDate":"2024-01-01","sequence":2}}'), "s1", "0", (("functionalThresholdPower", "200"), ("metaData", '{"calendarDate":"2024-01-01","sequence":2}'))),
        ("hill_score_daily", "hill_score_daily:" + sha("2024-01-05"), "s2", "0", (("calendarDate", '"2024-01-05"'), ("overallScore", "3"))),
    }
    assert got == want


def test_states_of_files_and_merge(found):
    files, rows, all_ = found
    assert {tuple(r) for r in observations.file_states(files, rows).collect()} == {("s1", "explicit_value", 7), ("s1", "parser_unsupported", 1), ("s2", "explicit_value", 2)}
    merged = observations.merged(all_, 2)
    got = {r["canonical_key"]: (r["presence_pattern"], r["raw_record"].get("name")) for r in merged["canonical"].where("dataset = 'activities'").collect()}
    assert got["garmin_activity:7"] == ("11", '"run"') and len(got) == 2
    told = {(r["snapshot_id"], r["merge_disposition"]) for r in merged["provenance"].where("canonical_key = 'garmin_activity:7'").collect()}
    assert told == {("s1", "superseded_record"), ("s2", "field_contributor")}


@pytest.mark.parametrize("text, naive, utc", [
    ('"2024-01-05T10:00:00+09:00"', "2024-01-05T01:00:00Z", "2024-01-05T01:00:00Z"), ('"2024-01-05 10:00:00.0"', "2024-01-05T10:00:00", "2024-01-05T10:00:00Z"), ('"2024-01-05T10:00:00.25Z"', "2024-01-05T10:00:00.250000Z", "2024-01-05T10:00:00.250000Z"),
    ('"2024-01-05"', "2024-01-05T00:00:00", "2024-01-05T00:00:00Z"), ("1704067200500", "2024-01-01T00:00:00.500000Z", "2024-01-01T00:00:00.500000Z"), ('"soon"', None, None), ("null", None, None), ("true", None, None), ('""', None, None),
])
def test_times_of_observations(spark, text, naive, utc):
    row = spark.createDataFrame([(text,)], "j string").select(times.moment(F.col("j")).alias("a"), times.moment(F.col("j"), True).alias("b")).first()
    assert (row["a"], row["b"]) == (naive, utc)


def test_selection_by_prefix_and_sentinels(spark):
    from pacelake.sources import families, fit

    paths = ["DI/HillScore_1.json", "a.zip!DI/hillscore.json", "DI/x_HillScore.json", "hillscore/none.json", "DI/EnduranceScore.json"]
    found = families.named(spark.createDataFrame([(p,) for p in paths], "provenance_path string"), ["hillscore"])
    assert {r[0] for r in found.collect()} == set(paths[:2])
    decoded = spark.createDataFrame([('{"lap.avg_power":2,"session.sport":0}',), ('{"lap.avg_power":1}',), (None,)], "sentinels string")
    assert [tuple(r) for r in fit.sentinel_counts(decoded).collect()] == [("lap.avg_power", 3)]
