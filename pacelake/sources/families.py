"""Closed vocabularies of sources: families of file names, groups of sports, patterns of private data."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rule of each source family, in order (part of the name, how it is tested, family).
FAMILY_RULES = [
    ("summarizedactivities.json", "ends", "activities"),
    ("gear.json", "ends", "gear"),
    ("personalrecord.json", "ends", "personal_records"),
    ("hillscore", "starts", "hill_score"),
    ("endurancescore", "starts", "endurance_score"),
    ("runracepredictions", "starts", "race_prediction"),
    ("sleepdata.json", "ends", "sleep"),
    ("udsfile", "starts", "uds"),
    ("metricsacutetrainingload", "starts", "acute_training_load"),
    ("trainingreadinessdto", "starts", "training_readiness"),
    ("activityvo2max", "starts", "vo2max"),
    ("metricsmaxmetdata", "starts", "vo2max"),
    ("traininghistory", "starts", "training_history"),
    ("userbiometrics.json", "ends", "lactate_threshold"),
    ("biometrics_latest.json", "ends", "lactate_threshold"),
    ("userbiometricprofiledata.json", "ends", "lactate_threshold"),
    ("heartratezones.json", "ends", "lactate_threshold"),
]

#: Patterns of private data in free text, as RE2 and Java both read them.
PRIVACY_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "url": r"https?://[A-Za-z0-9.-]+",
}


# What must not occur in what is shared, as Java reads it, by a name of ours.
PRIVACY_RULES = {
    "private_path": r"(?i)(?:/Users/|/home/|/private/|/var/folders/|(?:^|[\s\"'=:])private/(?:source|input|output|tmp)/|[A-Za-z]:\\|file://)",
    "address": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "share_or_instant": r"(?:\\\\[^\\\r\n]+\\[^\\\r\n]+|\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|(?<![0-9A-Fa-f])(?:\d{10}|\d{13})(?![0-9A-Fa-f]))",
    "place_or_identity": r"(?i)(?:latitude|longitude|coordinate|route\s*[:=]|(?:source|manifest|records|output|private_output)_(?:sha256|digest)|deterministic_output_digest|stable_key|snapshot_id|activity_id|device_id|account_id|garmin_activity\s*:)",
    "secret_or_failure": r"(?i)(?:traceback|authorization\s*:\s*(?:bearer|basic)|api[_-]?key|cookie|password\s*[:=]|token\s*[:=]|secret\s*[:=]|-----BEGIN [A-Z ]*PRIVATE KEY-----|exception(?:\s+message)?|\b(?:[A-Za-z]+Error|warning|free-form warning)\s*[:=]|\bFile\s+\"[^\"]+\",\s+line\s+\d+)",
    "coordinates": r"[-+]?\d{1,2}\.\d+\s*,\s*[-+]?\d{1,3}\.\d+",
    "source_field": r"(?i)\"(?:activityId|summaryId|calendarDate|startTimeInSeconds|deviceId|userProfileId)\"\s*:",
    "host_field": r"(?i)\"(?:hostname|username|cwd|home|executable|environment|env_vars|locale|package_list)\"\s*:",
    "host_line": r"(?i)\b(?:hostname|username|cwd|home|executable|environment|env(?:_vars)?|locale|package[ _-]?list)\s*[:=]",
    "upload": r"(?i)\"automatic_upload\"\s*:\s*true",
    "raw_data": r"(?i)(?:raw[_ -]?(?:fit|csv|garmin)|FIT\x00|(?:^|[\r\n])(?:calendarDate\s*,\s*activityId|activityId\s*,\s*calendarDate)(?:,|[\r\n])|(?:^|\n)[^\r\n,]+(?:,[^\r\n,]+)+\r?\n[^\r\n,]+(?:,[^\r\n,]+)+)",
}


# Of each rule, lower-cased texts of which one is in whatever breaks it; of rules that aren't here there is no such text.
PRIVACY_HINTS = {
    "private_path": ["/users/", "/home/", "private/", "/var/folders/", ":\\", "file://"],
    "address": ["@"],
    "place_or_identity": ["latitude", "longitude", "coordinate", "route", "_sha256", "_digest", "stable_key", "snapshot_id", "activity_id", "device_id", "account_id", "garmin_activity"],
    "secret_or_failure": ["traceback", "authorization", "api", "cookie", "password", "token", "secret", "private key", "exception", "error", "warning", "file"],
    "source_field": ['activityid"', 'summaryid"', 'calendardate"', 'starttimeinseconds"', 'deviceid"', 'userprofileid"'],
    "host_field": ['hostname"', 'username"', 'cwd"', 'home"', 'executable"', 'environment"', 'env_vars"', 'locale"', 'package_list"'],
    "host_line": ["hostname", "username", "cwd", "home", "executable", "env", "locale", "package"],
    "upload": ['"automatic_upload"'],
}


def _broken(text: str, lower: str, name: str, pattern: str) -> Column:
    """Whether a text breaks a rule; the pattern is tried only where one of its hints occurs."""
    found = F.col(text).rlike(pattern)
    if PRIVACY_RULES.get(name) != pattern or name not in PRIVACY_HINTS:
        return found
    hinted = F.lit(False)
    for hint in PRIVACY_HINTS[name]:
        hinted = hinted | F.contains(F.col(lower), F.lit(hint))
    return hinted & found


def privacy_findings(rows: DataFrame, text: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with one row for each rule that the text breaks, named ``rule``; all rules are tried in one pass."""
    lower = "_lower_case"
    hits = [F.when(_broken(text, lower, name, pattern), F.lit(name)) for name, pattern in (rules or PRIVACY_RULES).items()]
    return rows.withColumn(lower, F.lower(text)).withColumn("rule", F.explode(F.array_compact(F.array(*hits)))).drop(lower)


def _fold(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n).casefold())


def folded(name: str) -> Column:
    """NFC and case folding, which no column function has."""
    return F.pandas_udf(_fold, "string")(name)


def name_collisions(paths: DataFrame, path: str) -> DataFrame:
    """``folded_path, path_count, first_path, last_path``: different names that a file system may take for one. Equal names are one; folding runs once for each."""
    each = paths.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n")).select("path", folded("path").alias("folded_path"))
    return each.groupBy("folded_path").agg(F.count("*").cast("long").alias("path_count"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("path_count > 1")


def classify(name: Column, kind: Column) -> Column:
    """The source family of a logical file name; binary files are ``fit``, and only JSON files have others."""
    base = F.lower(F.regexp_extract(name, r"([^/\\\\!]*)$", 1))
    out = F.lit("unclassified")
    for text, how, family in reversed(FAMILY_RULES):
        out = F.when(base.endswith(text) if how == "ends" else base.startswith(text), family).otherwise(out)
    return F.when(kind == "json", out).when(kind == "fit", "fit").otherwise("unclassified")


def named(assets: DataFrame, prefixes: list[str], path: str = "provenance_path") -> DataFrame:
    """Assets whose file name, that of the member within an archive, begins with one of the prefixes, in whatever case."""
    base = F.lower(F.regexp_extract(path, r"([^/\\\\!]*)$", 1))
    found = F.lit(False)
    for p in prefixes:
        found = found | base.startswith(p.lower())
    return assets.where(found)


def buckets(family: Column, kind: Column) -> Column:
    """The families whose readers take a file: its own, and for binary files heart-rate variability as well."""
    return F.array_distinct(F.when(kind == "fit", F.array(family, F.lit("hrv"))).otherwise(F.array(family)))


# Sports by the numbers of older binary files, and texts that mean another group.
SPORT_CODES = {"10": "strength_training", "11": "walking", "17": "hiking"}
SPORT_NAMES = {"running": ["street", "trail"], "strength_training": ["training", "fitness_equipment"]}
SPORT_PARTS = [("run", "running"), ("strength", "strength_training"), ("walk", "walking"), ("hik", "hiking")]


def sport_group(value: Column) -> Column:
    """The group of a sport, or its text with ``_`` for spaces and hyphens; null for an empty one."""
    t = F.translate(F.lower(F.trim(value.cast("string"))), "- ", "__")
    out = F.when(t == "", None).otherwise(t)
    for part, group in reversed(SPORT_PARTS):
        out = F.when(t.contains(part) | t.isin(SPORT_NAMES.get(group, [])), group).otherwise(out)
    for code, group in SPORT_CODES.items():
        out = F.when(t == code, group).otherwise(out)
    return out
