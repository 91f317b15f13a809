"""Quality and completeness of datasets, as aggregates with closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelake.operators.dedupe import observed


def dataset_qa(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row: rows, rows beyond the first of each key, rows with a missing key, keys with different rows."""
    missing = " OR ".join(f"coalesce(CAST({k} AS STRING), '') = ''" for k in keys)
    per_key = observed(df, keys, fields).groupBy(*keys).agg(F.sum("observation_count").alias("n"), F.count("*").alias("v"))
    per_key = per_key.withColumn("missing", F.expr(missing))

    def total(what: str, name: str):
        return F.coalesce(F.sum(F.expr(what)), F.lit(0)).cast("long").alias(name)

    return per_key.agg(total("n", "row_count"), total("CASE WHEN NOT missing THEN n - 1 ELSE 0 END", "duplicate_extra_rows"), total("CASE WHEN missing THEN n ELSE 0 END", "missing_key_rows"), total("CASE WHEN NOT missing AND v > 1 THEN 1 ELSE 0 END", "divergent_key_count"))


def inspect_records(df: DataFrame, keys: list[str], fields: list[str], updated_at: str | None = None) -> DataFrame:
    """One row of counters with a status: unresolved conflicts go before null keys, those before ordered updates.

    Different rows under a key are an ordered update if ``updated_at`` tells all of them apart, else a conflict.
    """
    null_key = " OR ".join(f"{k} IS NULL" for k in keys)
    at = [updated_at] if updated_at else []
    # rows are compared by 128 bits, since numbers can be aggregated in place where rows have to be sorted
    marks = {f"h{i}": F.xxhash64(F.lit(i), *fields, *[F.col(c).isNull() for c in fields]) for i in (0, 1)}
    rows = df.select(*keys, *[F.col(c).alias("__at") for c in at], *[h.alias(n) for n, h in marks.items()])
    bounds = [f(n).alias(f"{name}_{n}") for n in marks for name, f in (("lo", F.min), ("hi", F.max))]
    differs = lambda: (F.col("lo_h0") != F.col("hi_h0")) | (F.col("lo_h1") != F.col("hi_h1"))
    each = rows.groupBy(*keys, *["__at" for _ in at]).agg(F.count("*").alias("n"), *bounds)
    # all rows of one stamp are equal, and there is a stamp
    told_apart = F.min((~differs() & F.col("__at").isNotNull()).cast("int")) if at else F.lit(0)
    again = [f(f"{name}_{n}").alias(f"{name}_{n}") for n in marks for name, f in (("lo", F.min), ("hi", F.max))]
    per_key = each.groupBy(*keys).agg(F.sum("n").alias("n"), told_apart.alias("ordered"), *again)
    per_key = per_key.select("n", F.expr(null_key).alias("null_key"), differs().alias("differs"), (F.col("ordered") == 1).alias("ordered"))

    def total(what: str, name: str):
        return F.coalesce(F.sum(F.expr(what)), F.lit(0)).cast("long").alias(name)

    out = per_key.agg(
        total("CASE WHEN null_key THEN n ELSE 0 END", "null_key_rows"),
        total("CASE WHEN NOT null_key AND n > 1 THEN 1 ELSE 0 END", "duplicate_key_groups"),
        total("CASE WHEN NOT null_key AND n > 1 AND NOT differs THEN 1 ELSE 0 END", "exact_duplicate_groups"),
        total("CASE WHEN NOT null_key AND differs AND ordered THEN 1 ELSE 0 END", "ordered_update_groups"),
        total("CASE WHEN NOT null_key AND differs AND NOT ordered THEN 1 ELSE 0 END", "unresolved_conflict_groups"),
    )
    status = F.when(F.col("unresolved_conflict_groups") > 0, "FAIL_UNRESOLVED_CONFLICT").when(F.col("null_key_rows") > 0, "FAIL_NULL_KEY").when(F.col("ordered_update_groups") > 0, "PASS_WITH_ORDERED_UPDATES").otherwise("PASS")
    return out.withColumn("status", status)


def daily_projection(df: DataFrame, date: Column, timestamp: Column) -> DataFrame:
    """One row: dates, dates with several observations, the most in one, first and last timestamp."""
    per_day = df.groupBy(date.alias("d")).agg(F.count("*").alias("n"), F.min(timestamp).alias("lo"), F.max(timestamp).alias("hi"))
    return per_day.agg(F.count("*").cast("long").alias("date_count"), F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("multi_observation_date_count"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_observations_per_date"), F.min("lo").alias("first_observation"), F.max("hi").alias("last_observation"))


def completeness(families: DataFrame) -> DataFrame:
    """State and validity of families with ``candidate_count, malformed_count, row_count``."""
    present = F.when(F.col("candidate_count") == 0, "ABSENT").when(F.col("malformed_count") > 0, "PRESENT").when(F.col("row_count") > 0, "PRESENT").otherwise("EMPTY")
    valid = F.when(F.col("candidate_count") == 0, "NOT_APPLICABLE").when(F.col("malformed_count") > 0, "MALFORMED").otherwise("VALID")
    return families.withColumn("state", present).withColumn("content_validity", valid)


def binary_completeness(families: DataFrame) -> DataFrame:
    """State, validity and reason of families of binary files, with counts of readable, unreadable, unsupported and malformed files.

    Evidence of more than one kind is ambiguous, as are files that no count accounts for; neither is decided here.
    """
    kinds = [F.col(f"{k}_count") for k in ("readable", "unreadable", "unsupported", "malformed")]
    readable, unreadable, unsupported, malformed = (k > 0 for k in kinds)
    mixed = sum((k > 0).cast("int") for k in kinds) > 1
    rules = [
        (F.col("candidate_count") == 0, ("ABSENT", "NOT_APPLICABLE", "SOURCE_NOT_OBSERVED")), (kinds[0] + kinds[1] + kinds[2] + kinds[3] != F.col("candidate_count"), ("AMBIGUOUS", "UNKNOWN", "FIT_CLASSIFICATION_INCOMPLETE")), (mixed, ("AMBIGUOUS", "UNKNOWN", "MIXED_FIT_EVIDENCE")),
        (unreadable, ("UNREADABLE", "UNKNOWN", "FIT_NOT_READABLE")), (unsupported, ("UNSUPPORTED", "NOT_APPLICABLE", "FIT_FORM_UNSUPPORTED")), (malformed, ("PRESENT", "MALFORMED", "FIT_EVIDENCE_PRESENT")),
        (F.col("row_count") > 0, ("PRESENT", "VALID", "FIT_EVIDENCE_PRESENT")), (F.lit(True), ("EMPTY", "VALID", "SOURCE_STRUCTURALLY_EMPTY")),
    ]
    return families.withColumns({name: first_reason([(holds, names[i]) for holds, names in rules]) for i, name in enumerate(("state", "content_validity", "reason_code"))})


def rollup(datasets: DataFrame, family: str) -> DataFrame:
    """Per family: datasets, records, warnings and a status."""
    out = datasets.groupBy(family).agg(F.count("*").cast("long").alias("dataset_count"), F.sum("record_count").cast("long").alias("record_count"), F.sum("warning_count").cast("long").alias("warning_count"))
    return out.withColumn("status", F.when(F.col("record_count") == 0, "EMPTY").when(F.col("warning_count") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def state_consensus(states: DataFrame, family: str) -> DataFrame:
    """One row per family: the state and validity that all snapshots share, else AMBIGUOUS and UNKNOWN. Counts are summed; where there are ``reason_code``s, all of them are listed."""
    codes = [F.array_join(F.array_sort(F.collect_set("reason_code")), ",").alias("reason_codes")] if "reason_code" in states.columns else []
    each = states.groupBy(family).agg(F.min(F.struct("state", "content_validity")).alias("lo"), F.max(F.struct("state", "content_validity")).alias("hi"), F.sum("row_count").cast("long").alias("row_count"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), *codes)
    same = F.col("lo") == F.col("hi")
    return each.select(family, F.when(same, F.col("lo.state")).otherwise("AMBIGUOUS").alias("state"), F.when(same, F.col("lo.content_validity")).otherwise("UNKNOWN").alias("content_validity"), "row_count", "states", *["reason_codes" for _ in codes])


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def coverage_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6))


# Which validity goes with which state, and what a reader is told of a state.
STATE_VALIDITY = {"PRESENT": ["VALID", "MALFORMED"], "EMPTY": ["VALID"], "ABSENT": ["NOT_APPLICABLE"], "UNREADABLE": ["UNKNOWN"], "UNSUPPORTED": ["NOT_APPLICABLE"], "AMBIGUOUS": ["UNKNOWN"]}
GUIDANCE = {
    "PRESENT": "CONSULT_CONTENT_VALIDITY_AND_RUN_QUALITY", "EMPTY": "SUPPORTED_SOURCE_CONTAINED_ZERO_OBSERVATIONS", "ABSENT": "DO_NOT_INFER_ZERO_OR_DELETION",
    "UNREADABLE": "OBTAIN_COMPLETE_READABLE_EXPORT", "UNSUPPORTED": "SOURCE_FORM_NOT_SUPPORTED_BY_THIS_VERSION", "AMBIGUOUS": "REVIEW_REQUIRED_NO_WINNER_SELECTED",
}
BINARY_COUNTS = ["readable_count", "unreadable_count", "unsupported_count", "malformed_count"]


def snapshot_completeness(counts: DataFrame, snapshots: DataFrame, families: list[str]) -> DataFrame:
    """State, validity, reason and guidance of every family in every snapshot; what a snapshot has no file of is absent there, which says nothing of its records.

    ``counts`` have ``snapshot_id, family, candidate_count, row_count`` and ``BINARY_COUNTS``, of which families other than ``fit`` use the malformed ones; ``snapshots`` have ``snapshot_id``.
    """
    grid = snapshots.select("snapshot_id", F.explode(F.array(*map(F.lit, families))).alias("family"))
    each = grid.join(counts, ["snapshot_id", "family"], "left").na.fill(0, ["candidate_count", "row_count", *BINARY_COUNTS])
    binary = binary_completeness(each.where("family = 'fit'"))
    plain = completeness(each.where("family <> 'fit'"))
    reason = F.when(F.col("state") == "ABSENT", "SOURCE_NOT_OBSERVED").when(F.col("state") == "EMPTY", "SOURCE_STRUCTURALLY_EMPTY").otherwise("SOURCE_EVIDENCE_PRESENT")
    out = plain.withColumn("reason_code", reason).unionByName(binary)
    guidance = F.element_at(F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair]), F.col("state"))
    readable = F.when(F.col("family") == "fit", F.col("readable_count")).otherwise(F.col("candidate_count"))
    return out.select("family", "snapshot_id", "state", "content_validity", "reason_code", "candidate_count", readable.alias("readable_asset_count"), "row_count", guidance.alias("user_guidance_id"))


def invalid_states(states: DataFrame) -> DataFrame:
    """Rows of which state and validity don't go together, or aren't of the vocabulary."""
    allowed = F.create_map(*[x for state, valid in STATE_VALIDITY.items() for x in (F.lit(state), F.array(*map(F.lit, valid)))])
    return states.where(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("state")), F.col("content_validity")), F.lit(False)))
