"""Sources: binary activity files, archives, wrappers, and the datasets of an invented export."""

import io
import zipfile

import pytest

from pacelake.plans import datasets, synthetic
from pacelake.sources import assets, families, fit, wrappers


def test_statuses_of_binary_files():
    good = synthetic.activity_file()
    assert fit.decode(good)["status"] == "parsed_activity"
    assert fit.decode(b"not-fit")["status"] == "too_small"
    assert fit.decode(good[:-3])["status"] == "truncated"
    assert fit.decode(good + good)["status"] == "unsupported_chained"
    assert fit.decode(good[:-1] + bytes([good[-1] ^ 1]))["status"] == "bad_file_crc"
    assert fit.decode(good[:8] + b"XXXX" + good[12:])["status"] == "bad_header"
    assert fit.decode(good[:12] + bytes([good[12] ^ 1]) + good[13:])["status"] == "bad_header_crc"


def test_sessions_laps_and_sentinels():
    found = fit.decode(synthetic.activity_file(laps=3, header=12))
    (session,) = found["sessions"]
    assert (len(session["laps"]), session["total_distance"], session["avg_power"]) == (3, 3000.0, None)
    assert found["sentinels"]["session.avg_power"] == 1
    assert [v for v, _ in fit.decode_hrv(synthetic.activity_file())] == [40.0, 41.0]


def test_laps_are_allocated_by_declared_numbers():
    assert fit.allocate([{"num_laps": 1}, {"num_laps": 2}], [1, 2, 3]) == [[1], [2, 3]]
    assert fit.allocate([{"num_laps": 1}, {"num_laps": 1}], [1, 2, 3]) is None


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "limits", "reason"),
    [
        (packed(**{"../a.json": "{}"}), assets.Limits(), "path_traversal"),
        (packed(**{"/a.json": "{}"}), assets.Limits(), "absolute_path"),
        (packed(**{"a.json": "{}", "b.json": "{}"}), assets.Limits(members=1), "too_many_members"),
        (packed(**{"a.json": "[" + "1," * 50 + "1]"}), assets.Limits(member_bytes=10), "member_too_large"),
        (packed(**{"a.json": "0" * 100_000}), assets.Limits(), "compression_ratio"),
        (b"no archive", assets.Limits(), "malformed_archive"),
    ],
)
def test_unsafe_archives_are_refused(data, limits, reason):
    with pytest.raises(assets.IntakeError, match=reason):
        list(assets.expand(data, limits))


def test_wrappers():
    assert wrappers.activities([{"x": [{"activityId": 1}]}, {"summarizedActivitiesExport": [{"activityId": 2}, 3]}]) == [{"activityId": 1}, {"activityId": 2}]
    assert wrappers.unwrap({"items": [{"a": 1}, 2]}, wrappers.WRAPPERS["daily"]) == [{"a": 1}]
    assert wrappers.unwrap({"a": 1}, wrappers.WRAPPERS["daily"]) == [{"a": 1}]


def test_intake_skips_junk_and_expands_archives(spark):
    rows = {r["provenance_path"]: r["family"] for r in synthetic.zip_intake(spark, "").collect()}
    assert rows["DI/parts.zip!a.fit"] == "fit" and rows["DI/UDSFile_1.json"] == "uds" and rows["DI/unknown.json"] == "unclassified"
    assert not any("__MACOSX" in p or p.endswith((".md", ".txt")) for p in rows)


def test_reading_from_a_folder_gives_the_same_assets(spark, tmp_path):
    for path, data in synthetic.export_files():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    assets.check_local_root(str(tmp_path))
    assert assets.same_inventory(assets.read_assets(spark, str(tmp_path)), synthetic.export_assets(spark))


def test_golden_activity(spark):
    first = next(r for r in synthetic.activities_golden(spark, "").collect() if r["activity_id"] == "1000")
    assert (first["garmin_activity_key"], first["activity_datetime_local"], first["distance_m"], first["duration_sec"]) == ("garmin_activity:1000", "2030-01-01T09:00:00+09:00", 5000.0, 600.0)


def test_datasets_of_the_export(spark):
    counts = {r["dataset"]: r["row_count"] for r in synthetic.run_all_counts(spark, "").collect()}
    assert len(counts) == 17
    for name, n in {"activities": 3, "gear": 1, "activity_gear": 1, "personal_records": 2, "fit_sessions": 3, "fit_laps": 6, "race_prediction_daily": 2, "uds_daily": 3, "sleep_daily": 2, "hill_score_daily": 1, "vo2max_daily": 0, "training_history_daily": 0}.items():
        assert counts[name] == n, (name, counts)


def test_links_of_activities_and_sessions(spark):
    found, audits = datasets.normalize(spark, synthetic.export_assets(spark))
    keys = {r["garmin_activity_key"] for r in found["activity_fit_links"].collect()}
    assert {"garmin_activity:1001", "garmin_activity:1002"} <= keys
    assert {r["reason"] for r in audits["activity_gear_unresolved"].collect()} == {"activity_relationship_unresolved_valid_link"}


def test_suffixes_wrappers_and_record_level_tables(spark):
    import json

    from pacelake.plans import health, variability
    from pacelake.sources import wrappers

    day = {"calendarDate": "2030-01-01", "metrics": [{"type": "hrv", "value": 40}, 3, {"type": "HRV", "value": 41.5}, {"type": "HR", "value": "50"}]}
    night = {"sleepStartTimestampGMT": "2030-01-01T13:00:00.0", "sleepEndTimestampGMT": "2030-01-01T21:00:00.0"}
    files = {"DI/a_healthStatusData.json": {"healthStatusData": [day, 7]}, "DI/a_healthstatusdata.json": [day], "DI/x_sleepData.json": {"sleepData": [night, {"retro": True}], "data": [night]}}
    rows = [(path, len(json.dumps(value)), bytearray(json.dumps(value).encode())) for path, value in files.items()]
    found = assets.assets_of(spark.createDataFrame(rows, "source_path string, size_bytes long, data binary"))
    daily, metrics = health.health_status(found)
    assert [(r["source_metric_count"], r["health_status_hr_value"], r["health_status_hrv_value"], r["health_status_reason_code"]) for r in daily.collect()] == [(3, 50.0, None, "health_status_duplicate_metric_type")]
    assert metrics.count() == 3 and {r["daily_selection_status"] for r in metrics.collect()} == {"selected_for_daily"}
    assert [(r["value"], r["reference_status"]) for r in variability.references(found).collect()] == [(41.5, "reference_available")]
    assert sorted(r["sleep_reason_code"] for r in health.sleep_records(found).collect()) == ["sleep_json_daily_available", "sleep_json_empty_retro_only_record"]
    marked = spark.createDataFrame([("DI/b_healthStatusData.json", 5, bytearray(b"\xef\xbb\xbf[]"))], "source_path string, size_bytes long, data binary")
    with pytest.raises(Exception, match="BOM"):
        wrappers.suffix_rows(assets.assets_of(marked), "healthStatusData.json", "health").collect()


def test_conflicts_fail_the_job_that_reads_them(spark):
    from pacelake.operators import dedupe, endpoints

    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None)], "k int, v string")
    assert dedupe.sound(twice.where("k = 1"), ["k"], ["v"]).collect() == [(1, "a")]
    assert [tuple(r) for r in dedupe.canonical(twice, ["k"], ["v"]).collect()] == [(1, "a")]
    for bad in (dedupe.sound(twice, ["k"], ["v"]), endpoints.unique_keys(twice, "k"), endpoints.unique_index(twice.union(spark.createDataFrame([(1, "c")], "k int, v string")), "k", "v")):
        with pytest.raises(Exception, match="conflict|more than once"):
            bad.collect()


def test_files_of_a_folder_are_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert assets.read_assets(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="file_too_large"):
        assets.read_assets(spark, str(tmp_path), assets.Limits(member_bytes=1)).collect()
    (tmp_path / "b.json").symlink_to(tmp_path / "a.json")
    with pytest.raises(assets.IntakeError):
        assets.read_assets(spark, str(tmp_path))


def test_sport_message_of_a_file(spark):
    rows = [(12, [(0, 1, 2, bytes([11])), (1, 1, 2, bytes([0])), (3, 8, 7, b"Evening\0")]), (18, [synthetic._u32(2, 5), synthetic._u8(5, 1), synthetic._u16(26, 0)])]
    data = fit.encode(rows)
    found = fit.decoded(assets.assets_of(spark.createDataFrame([("a.fit", len(data), bytearray(data))], "source_path string, size_bytes long, data binary"))).first()
    assert (found["file_sport"], found["file_sport_name"], found["sessions"][0]["sport"]) == ("walking", "Evening", "running")


def test_hints_of_privacy_rules_leave_out_no_text(spark):
    """With hints and without, on texts that break each rule, in capitals as well, and on texts that only hold a hint."""
    texts = ["see /Users/x", "at file://x", "c:\\x", "='private/tmp/", "a.b@c.de", "Latitude", "route : 1", "records_digest", "Garmin_Activity :", "Traceback", "authorization: basic", "api-key", "apikey", "cookie", "password=1",
             "-----BEGIN RSA PRIVATE KEY-----", "ValueError: x", "free-form warning =", 'File "x", line 3', "exception message", '"deviceId" :', '"env_vars":', '"package_list" :', "package list = 1", "env: 1", "locale=1", '"automatic_upload": true', "a@", "filed", "home", "private/", "1234567890", "1.5, 2.5", "a,b\nc,d", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts + [t.upper() for t in texts if t]], "text string")
    found = families.privacy_findings(rows, "text")
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString()
    plain = families.privacy_findings(rows, "text", {n: f"(?:{p})" for n, p in families.PRIVACY_RULES.items()})
    assert sorted(found.collect()) == sorted(plain.collect()) and {r.rule for r in found.collect()} == set(families.PRIVACY_RULES)
