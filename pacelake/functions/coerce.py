"""Typed reading of source fields, each given as canonical JSON text (SQL null: the field is absent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest integer that doubles hold exactly.
SAFE_INTEGER = 2**53 - 1
_NUMBER = r"^-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _unquoted(json: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def is_text(json: Column) -> Column:
    return F.coalesce(json.startswith('"'), F.lit(False))


def is_number(json: Column) -> Column:
    return F.coalesce(json.rlike(r"^-?\d"), F.lit(False))


def is_object(json: Column) -> Column:
    return F.coalesce(json.startswith("{"), F.lit(False))


def text(json: Column) -> Column:
    """A string that isn't empty."""
    return F.when(is_text(json) & (json != '""'), _unquoted(json))


def any_text(json: Column) -> Column:
    """Strings and numbers as text; null for booleans, null and containers."""
    return F.when(is_text(json), text(json)).when(is_number(json), json)


def number(json: Column, strings: bool = True, bounded: str = "integers") -> Column:
    """A finite number; booleans are null. Numeric strings count if ``strings``.

    ``bounded`` tells what must not exceed 2**53 - 1: JSON ``integers``, ``all`` numbers, or ``none``.
    """
    raw = F.when(is_number(json), json)
    if strings:
        raw = F.when(is_text(json), F.trim(_unquoted(json))).otherwise(raw)
    value = F.when(raw.rlike(_NUMBER), raw.try_cast("double"))
    large = F.abs(value) > SAFE_INTEGER
    over = {"integers": json.rlike(r"^-?\d+$") & large, "all": large, "none": F.lit(False)}[bounded]
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | over, None).otherwise(value)


def integer(json: Column) -> Column:
    """A JSON integer: neither a boolean, a string nor a number with a point."""
    return F.when(json.rlike(r"^-?\d{1,18}$"), json.try_cast("long"))


def boolean(json: Column) -> Column:
    return F.when(json == "true", True).when(json == "false", False)


def field(json: Column, *path: str) -> Column:
    """The canonical JSON of a nested field of an object, null if it is absent."""
    for name in path:
        json = F.from_json(F.when(is_object(json), json), "map<string,variant>")[name]
        json = F.to_json(json)
    return json
