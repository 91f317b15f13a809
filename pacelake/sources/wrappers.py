"""Rows of JSON files, as maps of field name to canonical JSON text.

The text keeps what a typed column would lose: whether a field is absent, null, empty
or zero, and whether a number was written as an integer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "provenance_path string, sha256 string, record_index long, parent string, record map<string,string>"

# Names of wrapping lists, by kind of file, in the order they are tried.
WRAPPERS = {
    "daily": ["data", "items", "records", "values", "summaries", "sleepData"],
    "performance": ["records", "items", "data"],
    "sleep": ["sleepData", "data", "records", "items"],
    "health": ["healthStatusData", "data", "records", "items", "values", "summaries"],
}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unwrap(value: object, names: list[str]) -> list[dict]:
    """The objects of a list, of the first wrapping list that there is, or the object itself."""
    if isinstance(value, dict):
        value = next((value[n] for n in names if isinstance(value.get(n), list)), [value])
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else []


def activities(value: object) -> list[dict]:
    """Activity objects at any depth."""
    out: list[dict] = []
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            inner = x.get("summarizedActivitiesExport")
            if isinstance(inner, list):
                out += [r for r in inner if isinstance(r, dict)]
            elif "activityId" in x:
                out.append(x)
            else:
                stack.extend(v for v in reversed(list(x.values())) if isinstance(v, list | dict))
    return out


def listed(name: str):
    """Rows of the list ``name`` of each object, with their place in it."""

    def read(value: object) -> list[dict]:
        tops = value if isinstance(value, list) else [value]
        return [r for t in tops if isinstance(t, dict) and isinstance(t.get(name), list) for r in t[name] if isinstance(r, dict)]

    return read


def gear_links(value: object) -> list[tuple[str, dict]]:
    """(gear key, link) of maps from gear to lists of links."""
    tops = value if isinstance(value, list) else [value]
    maps = [t["gearActivityDTOs"] for t in tops if isinstance(t, dict) and isinstance(t.get("gearActivityDTOs"), dict)]
    return [(key, row) for m in maps for key, rows in m.items() if isinstance(rows, list) for row in rows if isinstance(row, dict)]


def suffix_rows(assets: DataFrame, suffix: str, kind: str) -> DataFrame:
    """Rows of the JSON files whose names end exactly in ``suffix``, unwrapped as files of this kind are; a byte-order mark fails the job."""
    names = list(WRAPPERS[kind])
    return json_rows(assets.where(F.coalesce("member_path", "source_path").endswith(suffix)), lambda v: unwrap(v, names), "utf-8")


def json_rows(assets: DataFrame, read, encoding: str = "utf-8-sig") -> DataFrame:
    """A row for each object that ``read`` finds in each JSON file; a file that isn't JSON fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, sha, data in zip(batch["provenance_path"], batch["sha256"], batch["data"], strict=True):
                found = read(json.loads(bytes(data).decode(encoding)))
                rows = [r if isinstance(r, tuple) else (None, r) for r in found]
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame([(path, sha, k + i, parent, {n: canonical(v) for n, v in row.items()}) for i, (parent, row) in enumerate(rows[k : k + 5000])], columns=["provenance_path", "sha256", "record_index", "parent", "record"])

    return assets.where("kind = 'json'").select("provenance_path", "sha256", "data").mapInPandas(run, SCHEMA)
