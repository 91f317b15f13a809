"""The time conversions of exports, which must not be mixed: UTC days, product-local times, source timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The product's time zone, without daylight saving since 1952.
ZONE, OFFSET = "Asia/Tokyo", "+09:00"
#: Seconds from the Unix epoch to that of binary activity files.
FIT_EPOCH = 631_065_600

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _local(ms: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), ZONE)


def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def local_day(ms: Column) -> Column:
    return F.date_format(_local(ms), "yyyy-MM-dd")


def local_iso(ms: Column) -> Column:
    """ISO-8601 with offset; microseconds only where they aren't zero."""
    return F.concat(F.date_format(_local(ms), "yyyy-MM-dd'T'HH:mm:ss"), F.when(ms % 1000 != 0, F.concat(F.lit("."), F.lpad((F.pmod(ms, F.lit(1000)) * 1000).cast("string"), 6, "0"))).otherwise(""), F.lit(OFFSET))


def fit_iso(seconds: Column) -> Column:
    return local_iso((seconds.cast("long") + FIT_EPOCH) * 1000)


def calendar_date(text: Column) -> Column:
    """A date label: epoch milliseconds as a UTC day, text by its first ten characters if they are a date."""
    head = F.substring(text, 1, 10)
    day = F.when(head.rlike(ISO_DATE) & F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).isNotNull(), head)
    return F.when(text.rlike(r"^-?\d+$") & (F.length(text) != 10), utc_day(text.try_cast("long"))).otherwise(day)


# What is known of the time zone of an observation.
MISSING, INVALID, NAIVE, NAMED_UTC, EPOCH, OFFSET_UTC = "MISSING", "INVALID", "NAIVE_ISO8601_TIMEZONE_UNCONFIRMED", "SOURCE_FIELD_NAMED_UTC_OR_GMT", "EPOCH_MILLISECONDS_UTC", "EXPLICIT_OFFSET_UTC_NORMALIZED"


def _iso(t: Column, zone: str) -> Column:
    """ISO-8601 of a UTC timestamp, microseconds only where they aren't zero."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(t) % 1_000_000 != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit(zone))


def observation_timestamp(text: Column, is_number: Column, named_utc: bool = False, utc: str = "Z") -> tuple[Column, Column]:
    """Value and semantics of a source timestamp. Instants end in ``utc``; naive texts stay naive, written alike, unless the field is named UTC or GMT.

    The session's time zone must be UTC.
    """
    trimmed = F.trim(text)
    iso = F.regexp_replace(trimmed, "Z$", "+00:00")
    aware = iso.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:?\d{2}$")
    naive = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    as_ms = F.timestamp_millis(text.try_cast("double").try_cast("long"))
    as_aware, as_naive = F.when(aware, iso.try_cast("timestamp")), F.when(naive, trimmed.try_cast("timestamp_ntz")).cast("timestamp")
    value = F.when(is_number, _iso(as_ms, utc)).when(as_aware.isNotNull(), _iso(as_aware, utc)).when(as_naive.isNotNull(), _iso(as_naive, utc if named_utc else ""))
    known = F.when(as_aware.isNotNull(), OFFSET_UTC).when(as_naive.isNotNull(), NAMED_UTC if named_utc else NAIVE).otherwise(INVALID)
    return value, F.when(text.isNull() | (trimmed == ""), MISSING).when(is_number, EPOCH).otherwise(known)


def bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` refers to it; plans stay small where such steps are nested and filters are pushed through them."""
    return F.element_at(F.transform(F.array(value), then), 1)


def moment(json: Column, named_utc: Column | bool = False, utc: str = "Z") -> Column:
    """The value of ``observation_timestamp`` of canonical JSON text; ``named_utc`` may differ by row."""
    from pacelake.functions import coerce

    def read(v: Column) -> Column:
        as_utc, as_is = (observation_timestamp(v["text"], v["number"], flag, utc)[0] for flag in (True, False))
        return F.when(v["utc"], as_utc).otherwise(as_is)

    flag = F.lit(named_utc) if isinstance(named_utc, bool) else named_utc
    return bound(json, lambda j: bound(F.struct(coerce.any_text(j).alias("text"), coerce.is_number(j).alias("number"), F.coalesce(flag, F.lit(False)).alias("utc")), read))


def date_label(json: Column) -> Column:
    """The day of a date label given as canonical JSON text: numbers as epoch milliseconds in UTC, texts by the date that they begin with."""
    from pacelake.functions import coerce

    label = coerce.text(json)
    compact = F.regexp_replace(F.regexp_extract(label, r"^(\d{8})(T.*)?$", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    head = F.when(compact != "", compact).otherwise(F.substring(label, 1, 10))
    day = F.when(head.rlike(ISO_DATE) & F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).isNotNull(), head)
    return F.when(coerce.is_number(json), utc_day(json.try_cast("double").try_cast("long"))).otherwise(day)
