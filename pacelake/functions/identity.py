"""Stable identities: tokens, keys and fallback hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_token(value: Column, allow_zero: bool = False) -> Column:
    """Trimmed text; decimal numbers without leading zeros. Null, empty and (unless allowed) zero give null."""
    t = F.trim(value)
    n = F.regexp_replace(t, "^0+(?=[0-9])", "")
    out = F.when(t == "", None).when(t.rlike("^[0-9]+$"), n).otherwise(t)
    return out if allow_zero else F.when(out == "0", None).otherwise(out)


def keyed(prefix: str, token: Column) -> Column:
    return F.concat(F.lit(prefix), token)


def json_list(parts: list[Column]) -> Column:
    """A compact JSON array of strings and nulls."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(p.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null")) for p in parts]), F.lit("]"))


def canonical_key(dataset: str, parts: list[Column]) -> Column:
    """The key of a record across snapshots: that of an activity as it is, else dataset and hash of the parts; null if a part is null or empty."""
    if dataset == "activities":
        return F.when(parts[0] != "", parts[0])
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.coalesce(p.cast("string") != "", F.lit(False))
    return F.when(whole, F.concat(F.lit(f"{dataset}:"), F.sha2(json_list(parts), 256)))


def hash_key(prefix: str, parts: list[Column]) -> Column:
    """A key from 24 hex digits of the hash of fallback parts; null if all of them are null."""
    some = F.coalesce(*[p.cast("string") for p in parts])
    return F.when(some.isNotNull(), F.concat(F.lit(prefix), F.substring(F.sha2(json_list(parts), 256), 1, 24)))


def there(json: Column) -> Column:
    """Whether a field is there with something in it: neither absent nor null nor the empty text."""
    return F.coalesce(~json.isin("null", '""'), F.lit(False))


def json_hash_key(prefix: str, parts: list[Column]) -> Column:
    """A key from 24 hex digits of the hash of fallback parts given as canonical JSON, so that a number and its text differ; null if none of them is there."""
    some = F.lit(False)
    for p in parts:
        some = some | there(p)
    whole = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(p, F.lit("null")) for p in parts]), F.lit("]"))
    return F.when(some, F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 24)))
