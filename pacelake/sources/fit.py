"""Binary activity files: decoded once per distinct content, to sessions, laps and an audit row each."""

from __future__ import annotations

import json
import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 128 << 20

# Fixed values of the format: base types (format character, bytes, invalid value).
BASE_TYPES = {
    0x00: ("B", 1, 0xFF), 0x01: ("b", 1, 0x7F), 0x02: ("B", 1, 0xFF), 0x83: ("h", 2, 0x7FFF), 0x84: ("H", 2, 0xFFFF), 0x85: ("i", 4, 0x7FFFFFFF), 0x86: ("I", 4, 0xFFFFFFFF), 0x07: ("s", 1, None), 0x88: ("f", 4, None),
    0x89: ("d", 8, None), 0x0A: ("B", 1, 0x00), 0x8B: ("H", 2, 0x0000), 0x8C: ("I", 4, 0x00000000), 0x0D: ("B", 1, None), 0x8E: ("q", 8, 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 8, 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 8, 0x0000000000000000),
}
# Fixed values of the format: fields of sessions and laps that are kept (number, name, divisor).
SESSION = [(2, "start_time", 1), (5, "sport", 1), (6, "sub_sport", 1), (7, "total_elapsed_time", 1000), (8, "total_timer_time", 1000), (9, "total_distance", 100), (11, "total_calories", 1), (14, "avg_speed", 1000), (15, "max_speed", 1000), (16, "avg_heart_rate", 1), (17, "max_heart_rate", 1), (18, "avg_cadence", 1), (19, "max_cadence", 1), (20, "avg_power", 1), (21, "max_power", 1), (22, "total_ascent", 1), (23, "total_descent", 1), (26, "num_laps", 1), (253, "timestamp", 1)]
LAP = [(2, "start_time", 1), (7, "total_elapsed_time", 1000), (8, "total_timer_time", 1000), (9, "total_distance", 100), (13, "avg_speed", 1000), (14, "max_speed", 1000), (15, "avg_heart_rate", 1), (16, "max_heart_rate", 1), (17, "avg_cadence", 1), (18, "max_cadence", 1), (19, "avg_power", 1), (20, "max_power", 1), (21, "total_ascent", 1), (22, "total_descent", 1), (253, "timestamp", 1)]
SPORTS = {1: "running", 2: "cycling", 10: "strength_training", 11: "walking", 17: "hiking", 31: "swimming"}
SUB_SPORTS = {6: "treadmill_running", 7: "street", 8: "trail"}
SPORT = [(0, "sport", 1), (1, "sub_sport", 1), (3, "name", 1)]
MESSAGES = {12: ("sport", SPORT), 18: ("session", SESSION), 19: ("lap", LAP)}
RECORD, HRV_STATUS = 20, 370
# All but the first two are incomplete.
STATUSES = ["parsed_activity", "parsed_non_activity", "too_large", "too_small", "bad_header", "bad_header_crc", "bad_file_crc", "truncated", "undefined_local_message", "unsupported_chained", "session_lap_allocation_conflict"]




def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xA001 if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """CRC-16 with the reflected polynomial 0xA001, as the format has it."""
    crc = 0
    for byte in data:
        crc = (crc >> 8) ^ _TABLE[(crc ^ byte) & 0xFF]
    return crc


def problem(data: bytes) -> str | None:
    """The first reason why the file can't be decoded, in the order of the contract."""
    if len(data) > MAX_BYTES:
        return "too_large"
    if len(data) < 14:
        return "too_small"
    size = data[0]
    if size not in (12, 14) or data[8:12] != b".FIT":
        return "bad_header"
    whole = size + struct.unpack_from("<I", data, 4)[0] + 2
    if len(data) < whole:
        return "truncated"
    if len(data) > whole:
        return "unsupported_chained"
    if size == 14 and (stored := struct.unpack_from("<H", data, 12)[0]) and stored != crc16(data[:12]):
        return "bad_header_crc"
    if struct.unpack_from("<H", data, whole - 2)[0] != crc16(data[: whole - 2]):
        return "bad_file_crc"
    return None


def messages(data: bytes, start: int, end: int) -> Iterator[tuple[int, dict[int, tuple]] | None]:
    """(message number, values of each field) of every data message; None, and no more, for an undefined one.

    Invalid values are None. Offsets of compressed timestamps are ignored, developer fields skipped.
    """
    shapes: dict[int, tuple] = {}
    at = start
    while at < end:
        head = data[at]
        at += 1
        if not head & 0x80 and head & 0x40:
            order = ">" if data[at + 1] == 1 else "<"
            number, n = struct.unpack_from(order + "HB", data, at + 2)
            at += 5
            fields = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(n)]
            at += 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            shapes[head & 0x0F] = (order, number, fields, extra)
            continue
        local = (head >> 5) & 3 if head & 0x80 else head & 0x0F
        if local not in shapes:
            yield None
            return
        order, number, fields, extra = shapes[local]
        found = {}
        for field, size, base in fields:
            code, width, invalid = BASE_TYPES.get(base, ("B", 1, None))
            raw = data[at : at + size]
            at += size
            if code == "s":
                found[field] = (raw.split(b"\0")[0].decode("utf-8", "replace"),)
            elif size % width == 0 and len(raw) == size:
                found[field] = tuple(None if v == invalid else v for v in struct.unpack(f"{order}{size // width}{code}", raw))
        at += extra
        yield number, found


def _named(values: dict[int, tuple], fields: list[tuple], kind: str, sentinels: Counter) -> dict[str, float | None]:
    out: dict[str, float | None] = {}
    for number, name, divisor in fields:
        mine = values.get(number)
        if mine is None:
            out[name] = None
            continue
        sentinels[f"{kind}.{name}"] += sum(v is None for v in mine)
        out[name] = mine[0] / divisor if len(mine) == 1 and mine[0] is not None and divisor > 1 else mine[0] if len(mine) == 1 else None
    return out


def allocate(sessions: list[dict], laps: list[dict]) -> list[list[dict]] | None:
    """The laps of each session by their declared numbers; None if the numbers don't add up."""
    if len(sessions) == 1:
        return [laps]
    if not sessions:
        return None if laps else []
    counts = [s["num_laps"] for s in sessions]
    if any(n is None or n < 0 for n in counts) or sum(counts) != len(laps):
        return None
    ends = [int(sum(counts[: i + 1])) for i in range(len(counts))]
    return [laps[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def decode(data: bytes) -> dict:
    """``status, sessions`` (each with its ``laps``), ``sport`` (the first message of that kind), ``records`` and ``sentinels`` of one file."""
    out: dict = {"status": problem(data), "sport": {}, "sessions": [], "records": 0, "sentinels": Counter()}
    if out["status"]:
        return out
    rows: dict[str, list] = {"sport": [], "session": [], "lap": []}
    try:
        for message in messages(data, data[0], len(data) - 2):
            if message is None:
                return out | {"status": "undefined_local_message"}
            number, values = message
            out["records"] += number == RECORD
            if number in MESSAGES:
                kind, fields = MESSAGES[number]
                rows[kind].append(_named(values, fields, kind, out["sentinels"]))
    except (IndexError, struct.error):
        return out | {"status": "truncated"}
    parts = allocate(rows["session"], rows["lap"])
    if parts is None:
        return out | {"status": "session_lap_allocation_conflict"}
    out["sport"] = rows["sport"][0] if rows["sport"] else {}
    out["sessions"] = [s | {"laps": part} for s, part in zip(rows["session"], parts, strict=True)]
    return out | {"status": "parsed_activity" if rows["session"] else "parsed_non_activity"}


def decode_hrv(data: bytes) -> list[tuple[float | None, int | None]]:
    """(value, timestamp) of each heart-rate-variability message; the checks of checksums and chaining don't apply here."""
    if len(data) < 14 or data[8:12] != b".FIT":
        return []
    out = []
    try:
        for message in messages(data, data[0], min(len(data), data[0] + struct.unpack_from("<I", data, 4)[0])):
            if message is None:
                break
            number, values = message
            if number == HRV_STATUS:
                raw, at = values.get(1, (None,))[0], values.get(253, (None,))[0]
                out.append((None if raw is None else raw / 128, at))
    except (IndexError, struct.error):
        pass
    return out


_METRICS = [name for _, name, _ in SESSION if name not in ("start_time", "sport", "sub_sport", "num_laps", "timestamp")]
_LAP_METRICS = [name for _, name, _ in LAP if name not in ("start_time", "timestamp")]
_SCHEMA = (
    "sha256 string, source_path string, alias_count long, status string, records long, sentinels string, sessions array<struct<start_time:long,sport:string,sub_sport:string,"
    + ",".join(f"{m}:double" for m in _METRICS)
    + ",laps:array<struct<start_time:long,timestamp:long,"
    + ",".join(f"{m}:double" for m in _LAP_METRICS)
    + ">>>>, file_sport string, file_sport_name string"
)


def sport_names(sport: float | None, sub: float | None) -> tuple[str | None, str | None]:
    name, subname = SPORTS.get(sport), SUB_SPORTS.get(sub)
    return ("treadmill_running" if subname == "treadmill_running" else "trail_running" if subname == "trail" else name), subname


def decoded(assets: DataFrame) -> DataFrame:
    """A row for each distinct binary file: the first of its paths, status, counts and nested sessions with laps."""
    files = assets.where("kind = 'fit'")
    first = files.groupBy("sha256").agg(F.min("provenance_path").alias("source_path"), F.count("*").alias("alias_count"))  # contents stay where they are
    once = files.select("sha256", F.col("provenance_path").alias("source_path"), "data").join(first, ["sha256", "source_path"])

    def number(x: object) -> float | None:
        return float(x) if isinstance(x, int | float) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sha, path, aliases, data in batch.itertuples(index=False):
                d = decode(bytes(data))
                sessions = []
                for s in d["sessions"]:
                    sport, sub = sport_names(s["sport"], s["sub_sport"])
                    laps = [{"start_time": lap["start_time"], "timestamp": lap["timestamp"]} | {m: number(lap[m]) for m in _LAP_METRICS} for lap in s["laps"]]
                    sessions.append({"start_time": s["start_time"], "sport": sport, "sub_sport": sub, "laps": laps} | {m: number(s[m]) for m in _METRICS})
                yield pd.DataFrame([(sha, path, aliases, d["status"], d["records"], json.dumps(dict(sorted(d["sentinels"].items()))), sessions, sport_names(d["sport"].get("sport"), d["sport"].get("sub_sport"))[0], d["sport"].get("name") or None)], columns=["sha256", "source_path", "alias_count", "status", "records", "sentinels", "sessions", "file_sport", "file_sport_name"])

    return once.select("sha256", "source_path", "alias_count", "data").mapInPandas(run, _SCHEMA)


def hrv_rows(assets: DataFrame) -> DataFrame:
    """``provenance_path, hrv_value, fit_seconds`` of every message; aliases of one content are all read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in batch.itertuples(index=False):
                rows = decode_hrv(bytes(data))
                if rows:
                    yield pd.DataFrame([(path, v, t) for v, t in rows], columns=["provenance_path", "hrv_value", "fit_seconds"]).astype({"hrv_value": "float64", "fit_seconds": "Int64"})

    return assets.where("kind = 'fit'").select("provenance_path", "data").mapInPandas(run, "provenance_path string, hrv_value double, fit_seconds long")


def encode(rows: list[tuple[int, list[tuple[int, int, int, bytes]]]], header: int = 14) -> bytes:
    """A binary file of these messages, each with its own definition: (number, [(field, size, base type, bytes)]). For tests and samples."""
    body = b""
    for number, fields in rows:
        body += bytes([0x40, 0, 0]) + struct.pack("<HB", number, len(fields)) + b"".join(bytes(f[:3]) for f in fields) + b"\0" + b"".join(f[3] for f in fields)
    head = struct.pack("<BBHI4s", header, 0x20, 0x0846, len(body), b".FIT")
    head += struct.pack("<H", crc16(head)) if header == 14 else b""
    return head + body + struct.pack("<H", crc16(head + body))


def sentinel_counts(decoded: DataFrame) -> DataFrame:
    """``field_name, invalid_count``: how often each field of any file held the value that means none."""
    each = decoded.select(F.explode(F.from_json("sentinels", "map<string,bigint>")).alias("field_name", "n"))
    return each.where("n > 0").groupBy("field_name").agg(F.sum("n").alias("invalid_count"))
