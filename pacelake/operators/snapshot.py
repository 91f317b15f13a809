"""Merging repeated snapshots: absence is not deletion, null never replaces a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.operators import coverage


class SnapshotConflict(ValueError):
    """Different records of one key where order can't decide between them."""


def last_known(field: str, order: str):
    """The last value that isn't null, in the order of acquisition."""
    return F.expr(f"max_by({field}, {order}) FILTER (WHERE {field} IS NOT NULL)").alias(field)


def merge_fields(observations: DataFrame, keys: list[str], fields: list[str], order: str, snapshots: int) -> DataFrame:
    """One row per key: the last known value of every field, the presence pattern and its counts.

    ``observations`` has one row per key and snapshot, and no null in its keys.
    """
    each = observations.groupBy(*keys).agg(*[last_known(f, order) for f in fields], F.collect_set(order).alias("orders"), F.count("*").cast("long").alias("source_observation_count"))
    return coverage.flags(each.withColumn("presence_pattern", coverage.pattern("orders", snapshots)).withColumn("source_snapshot_count", F.size("orders").cast("long")).drop("orders"))


def split_holds(observations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are complete, and those held back because a component is null or empty."""
    missing = " OR ".join(f"coalesce(CAST({k} AS STRING), '') = ''" for k in keys)
    return observations.where(f"NOT ({missing})"), observations.where(missing)


def stop_conflicts(observations: DataFrame, keys: list[str], record: str, snapshot: str, observed_at: str, daily: bool = False) -> DataFrame:
    """Keys that emit nothing, with the reason: different records within a snapshot, at one time, or (daily) at all."""

    def differing(by: list[str], reason: str) -> DataFrame:
        return observations.groupBy(*keys, *by).agg(F.min(record).alias("lo"), F.max(record).alias("hi")).where("lo <> hi").select(*keys, F.lit(reason).alias("reason")).distinct()

    out = differing([snapshot], "different_records_within_snapshot").union(differing([observed_at], "different_records_at_one_time"))
    if daily:
        out = out.union(differing([], "different_daily_records"))
    return out.groupBy(*keys).agg(F.min("reason").alias("reason"))


_EMPTY = ['""', "[]", "{}"]


def state(value: str):
    """``explicit_null``, ``explicit_empty`` or ``explicit_value`` of canonical JSON; ``field_absent`` for SQL null."""
    v = F.col(value)
    return F.when(v.isNull(), "field_absent").when(v == "null", "explicit_null").when(v.isin(*_EMPTY), "explicit_empty").otherwise("explicit_value")


def merge_maps(observations: DataFrame, keys: list[str], record: str, order: list[str]) -> DataFrame:
    """``keys, field, value, state, held`` of every field of every key, from ``record`` maps of field to canonical JSON.

    The last explicit value wins; where there is none, the last null or empty. ``held`` names a null
    or empty that a later reader should look at: it came after a value, or nothing else has come.
    """
    rank = F.struct(*[F.col(c) for c in order])
    long_ = observations.select(*keys, rank.alias("rank"), F.explode(record).alias("field", "value"))
    long_ = long_.withColumn("state", state("value"))
    each = long_.groupBy(*keys, "field").agg(F.expr("max_by(value, rank) FILTER (WHERE state = 'explicit_value')").alias("known"), F.max_by("value", "rank").alias("last"), F.max_by("state", "rank").alias("last_state"), F.count("*").cast("long").alias("observation_count"))
    held = F.when(F.col("last_state") == "explicit_value", None).when(F.col("known").isNotNull(), F.concat("last_state", F.lit("_preserved_previous"))).otherwise(F.concat("last_state", F.lit("_review_required")))
    return each.select(*keys, "field", F.coalesce("known", "last").alias("value"), "observation_count", held.alias("held"))


def stable_json(record):
    """A record as one JSON text with sorted fields, whatever the order of its map."""
    name = lambda n: F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries(record)), lambda e: F.concat(F.lit('"'), name(e["key"]), F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def signature(record):
    """The SHA-256 of a record's stable JSON."""
    return F.sha2(stable_json(record), 256)


KEY = ["dataset", "canonical_key"]


def _named(observations: DataFrame) -> DataFrame:
    """Observations with their signature and their place in the order of acquisition, in which record numbers count as text."""
    at = F.struct("logical_order", "snapshot_id", "source_relative_path", F.col("source_record_index").cast("string").alias("record_index"), "source_record_index")
    return observations.withColumn("signature", signature("record")).withColumn("at", at)


def _nameless():
    return F.coalesce(F.col("canonical_key"), F.lit("")) == ""


def collapse(observations: DataFrame) -> DataFrame:
    """One row for each key and snapshot: the least and the greatest signature, how many observations, and the last of them.

    Combined before the shuffle, so a key with very many equal observations is small from there on. All that a merge needs but the list of its observations follows from these rows.
    """
    rows = _named(observations).where(~_nameless())
    each = rows.groupBy(*KEY, "logical_order", "snapshot_id", "export_observed_at").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi"), F.count("*").alias("n"), F.max_by(F.struct("at", "record"), "at").alias("last"))
    return each.select(*KEY, "logical_order", "snapshot_id", "export_observed_at", "lo", "hi", "n", F.col("last.at").alias("at"), F.col("last.record").alias("record"))


def _judged(rows: DataFrame, lo: str, hi: str, daily: Column, preserve: Column) -> DataFrame:
    """Marks what becomes of the key of each row: ``outcome`` is merged, variants or stopped. All windows work on one partitioning by key."""

    def differ(*by: str) -> Column:
        w = Window.partitionBy(*KEY, *by)
        return F.min(lo).over(w) != F.max(hi).over(w)

    at_once = Window.partitionBy(*KEY, "export_observed_at")
    rows = rows.repartition(*KEY).withColumn("within", differ("logical_order"))
    rows = rows.withColumn("at_once", differ("export_observed_at") & (F.min("snapshot_id").over(at_once) != F.max("snapshot_id").over(at_once)))
    rows = rows.withColumns({"stopped": F.bool_or(F.col("within") | F.col("at_once")).over(Window.partitionBy(*KEY)), "several": differ()})
    outcome = F.when(F.col("stopped"), "stopped").when(~F.col("several") | ~daily, "merged").when(preserve, "variants").otherwise("unequal")
    return rows.withColumn("outcome", outcome)


def _explicit():
    return F.col("parser_state") == "explicit_value"


def merge_collapsed(each: DataFrame, snapshots: int, daily: Column, preserve: Column) -> dict[str, DataFrame]:
    """What ``merge_observations`` returns but the lists of observations, from the rows of ``collapse``."""
    total = {"orders": F.collect_set("logical_order").over(Window.partitionBy(*KEY)), "total": F.sum("n").over(Window.partitionBy(*KEY))}
    base = _judged(each, "lo", "hi", daily, preserve).withColumns(total)

    def stop(mark: str, kind: str, found_at) -> DataFrame:
        return base.where(mark).select(*KEY, F.lit(kind).alias("conflict_type"), found_at.alias("found_at"))

    none = F.lit(None).cast("string")
    stops = stop("within", "divergent_duplicate_within_snapshot", F.col("logical_order").cast("string")).union(stop("at_once", "same_observation_time_different_value", F.col("export_observed_at").cast("string"))).union(stop("outcome = 'unequal'", "same_stable_key_different_public_value", none)).distinct()
    variants = base.where("outcome = 'variants'").groupBy(*KEY, F.col("lo").alias("signature")).agg(F.sum("n").cast("long").alias("observation_count"), F.array_join(F.array_sort(F.collect_set("logical_order")).cast("array<string>"), ",").alias("snapshot_orders"), F.min_by("record", "at").alias("observed_value"))

    merged = base.where("outcome = 'merged'")
    # a record without fields still counts as a row
    fields = merged.select(*KEY, "at", "n", "total", "orders", "several", F.explode_outer("record").alias("field_name", "value")).withColumn("parser_state", state("value"))
    in_order = Window.partitionBy(*KEY, "field_name").orderBy("at")
    earlier = F.max(_explicit().cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fields = fields.withColumn("preserved", ~_explicit() & (F.coalesce(earlier, F.lit(0)) == 1))
    previous = F.last(F.when(~F.col("preserved"), F.col("value")), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fields = fields.withColumn("changed", ~F.col("preserved") & F.coalesce(previous != F.col("value"), F.lit(False)))
    count = lambda s: F.sum(F.when(F.col("parser_state") == s, F.col("n")).otherwise(0)).alias(s)
    by_field = fields.groupBy(*KEY, "field_name").agg(
        F.expr("max_by(struct(value, parser_state, at), at) FILTER (WHERE NOT preserved)").alias("last"), F.sum(F.col("changed").cast("long")).alias("updates"), F.sum("n").alias("n_present"), *[count(s) for s in _STATES],
        F.first("total").alias("total"), F.first("orders").alias("orders"), F.first("several").alias("several"),
    )
    named = F.col("field_name").isNotNull()
    entries = F.array_sort(F.collect_list(F.when(named, F.struct("field_name", "last.value"))))
    keys = by_field.groupBy(*KEY).agg(
        F.map_from_entries(entries).alias("raw_record"), F.first("orders").alias("orders"), F.first("total").alias("source_observation_count"), F.first("several").alias("changed"), F.sum("updates").alias("updated_field_count"),
        *[F.sum(s).alias(s) for s in _STATES], F.sum(F.when(named, F.col("total") - F.col("n_present")).otherwise(0)).alias("field_absent"),
    )
    keys = coverage.flags(keys.withColumn("presence_pattern", coverage.pattern("orders", snapshots)).withColumn("source_snapshot_count", F.size("orders").cast("long")))
    provenance = by_field.where(named).select(*KEY, "field_name", F.col("last.parser_state").alias("value_state"), F.sha2("last.value", 256).alias("selected_value_sha256"), "last.at.snapshot_id", "last.at.logical_order", "last.at.source_relative_path", "last.at.source_record_index")

    one, flag = F.lit(1), lambda c: F.col(c).cast("long")
    of_keys = {"canonical_count": one, "changed_count": flag("changed"), "new_count": flag("is_new"), "previous_only_count": flag("is_previous_only"), "reappeared_count": flag("is_reappeared"), "updated_field_count": F.col("updated_field_count"),
               "single_variant_key_count": (~F.col("changed")).cast("long"), "observed_variant_count": (~F.col("changed")).cast("long"), "exact_repeat_count": F.when(F.col("changed"), 0).otherwise(F.col("source_observation_count") - 1),
               "record_absent": F.lit(snapshots) - F.col("source_snapshot_count"), "field_absent": F.col("field_absent"), **{s: F.col(s) for s in _STATES}}
    per_variant = base.where("outcome = 'variants'").groupBy(*KEY).agg(F.count_distinct("lo").alias("variants"), F.sum("n").alias("n"))
    of_variants = {"multi_variant_key_count": one, "observed_variant_count": F.col("variants"), "exact_repeat_count": F.col("n") - F.col("variants")}
    return {
        "canonical": keys.select(*KEY, "raw_record", "presence_pattern", "source_snapshot_count", "source_observation_count"), "conflicts": stops, "variants": variants, "field_provenance": provenance,
        "patterns": keys.groupBy("dataset", "presence_pattern").agg(F.count("*").alias("key_count")), "counters": counters(keys, of_keys).union(counters(per_variant, of_variants)),
    }


def digests(record) -> list[Column]:
    """128 bits that tell records apart, whatever the order of their maps, as two numbers, of which Spark keeps the least and the greatest without sorting rows."""
    return [F.xxhash64(F.lit(seed), F.sort_array(F.map_entries(record))) for seed in (1, 2)]


def key_rows(observations: DataFrame, daily: Column, preserve: Column, whole: bool = True) -> DataFrame:
    """One row for each key: ``total`` observations, the ``versions`` of its snapshots, its different ``texts``, ``several``, ``outcome`` and, of merged keys, ``orders``.

    A text is a record as JSON with sorted fields or, unless the ``whole`` of it is wanted, its ``digests``.
    Observations of a snapshot are combined before the first shuffle and all that follows works on the row of a key, so nothing is sorted by anything but keys.
    Rows without a key count as one key that is null.
    """
    key = F.when(~_nameless(), F.col("canonical_key"))
    at = ["logical_order", "snapshot_id", "export_observed_at"]
    texts = [F.to_json(F.map_from_entries(F.sort_array(F.map_entries("record"))))] if whole else digests("record")
    lo, hi = ([f"{side}{k}" for k in range(len(texts))] for side in ("lo", "hi"))
    rows = observations.select("dataset", key.alias("canonical_key"), *at, *[F.when(key.isNotNull(), t).alias(c) for c, t in zip(lo, texts, strict=True)])
    each = rows.groupBy(*KEY, *at).agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(d) for c, d in zip(lo, hi, strict=True)], F.count("*").alias("n"))
    same = F.lit(True)
    for c, d in zip(lo, hi, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(d))
    text = F.col(lo[0]) if whole else F.struct(*lo)
    keys = each.groupBy(*KEY).agg(F.sum("n").alias("total"), F.collect_list(F.struct(*at, "n", text.alias("text"), same.alias("same"))).alias("versions"))
    keys = keys.withColumns({"texts": F.array_distinct("versions.text"), "even": ~F.array_contains("versions.same", False), "orders": F.array_distinct("versions.logical_order")})
    keys = keys.withColumn("several", ~F.col("even") | (F.size("texts") > 1))
    # only versions of one order, or of one time, can be in each other's way
    within = (F.size("orders") < F.size("versions")) & (F.size(F.array_distinct(F.transform("versions", lambda v: F.struct(v["logical_order"], v["text"])))) > F.size("orders"))
    differ = lambda a, b: a["export_observed_at"].eqNullSafe(b["export_observed_at"]) & (a["snapshot_id"] != b["snapshot_id"]) & (a["text"] != b["text"])
    at_once = (F.size(F.array_distinct("versions.export_observed_at")) < F.size("versions")) & F.exists("versions", lambda a: F.exists("versions", lambda b: differ(a, b)))
    stopped = F.when(F.col("several"), ~F.col("even") | within | at_once).otherwise(False)
    outcome = F.when(F.col("canonical_key").isNull(), "nameless").when(stopped, "stopped").when(~F.col("several") | ~daily, "merged").when(preserve, "variants").otherwise("unequal")
    return keys.withColumn("outcome", outcome).withColumn("orders", F.when(F.col("outcome") == "merged", F.col("orders")))


def pattern_counts(keys: DataFrame, snapshots: int) -> DataFrame:
    """``dataset, presence_pattern, key_count`` of the merged keys among the rows of ``key_rows``; a pattern is made once for all keys that share it."""
    each = keys.where("outcome = 'merged'").groupBy("dataset", F.sort_array("orders").alias("orders")).agg(F.count("*").alias("key_count"))
    return each.select("dataset", coverage.pattern("orders", snapshots), "key_count")


def _changes(name: Column) -> Column:
    """How often the retained value of a field changes along the ``parsed`` versions: nulls and empties after a value don't replace it."""
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("changes"))

    def step(held: Column, value: Column) -> Column:
        explicit = ~value.isin("null", *_EMPTY)
        changes = held["changes"] + F.when(held["value"] != value, 1).otherwise(0).cast("long")
        return F.when(value.isNull() | (~explicit & held["known"]), held).otherwise(F.struct(value.alias("value"), explicit.alias("known"), changes.alias("changes")))

    values = F.transform("parsed", lambda v: v["record"][name])
    return F.aggregate(values, none, step, lambda held: held["changes"])


def key_counters(keys: DataFrame, snapshots: int) -> DataFrame:
    """The counters of each row of ``key_rows``."""
    merged, kept, several = F.col("outcome") == "merged", F.col("outcome") == "variants", F.col("several")
    # equal observations of all snapshots are parsed once
    once = F.array(F.struct(F.col("total").alias("n"), F.col("texts")[0].alias("text")))
    versions = F.when(merged, F.when(several, F.transform(F.array_sort("versions"), lambda v: F.struct(v["n"].alias("n"), v["text"].alias("text")))).otherwise(once))
    rows = keys.withColumn("parsed", F.transform(versions, lambda v: F.struct(v["n"].alias("n"), F.from_json(v["text"], "map<string,string>").alias("record"))))
    rows = rows.withColumn("names", F.array_distinct(F.flatten(F.transform("parsed", lambda v: F.map_keys(v["record"])))))
    total = lambda count: F.aggregate("parsed", F.lit(0).cast("long"), lambda sum_, v: sum_ + v["n"] * count(v["record"]))
    rows = rows.withColumns({
        "present": total(F.size), "explicit_null": total(lambda r: F.size(F.filter(F.map_values(r), lambda x: x == "null"))), "explicit_empty": total(lambda r: F.size(F.filter(F.map_values(r), lambda x: x.isin(*_EMPTY)))),
        "updates": F.when(several, F.aggregate("names", F.lit(0).cast("long"), lambda sum_, name: sum_ + _changes(name))),
    })
    rows = coverage.flags(rows.withColumn("presence_pattern", coverage.pattern("orders", snapshots)))
    if_ = lambda c, value=1: F.when(c, value).otherwise(0)
    alone, different = merged & ~several, F.size("texts")
    of_keys = {
        "observation_count": F.col("total"), "null_key_hold_count": if_(F.col("outcome") == "nameless", F.col("total")), "canonical_count": if_(merged), "changed_count": if_(merged & several),
        "new_count": if_(merged & F.col("is_new")), "previous_only_count": if_(merged & F.col("is_previous_only")), "reappeared_count": if_(merged & F.col("is_reappeared")), "updated_field_count": if_(merged & several, F.col("updates")),
        "single_variant_key_count": if_(alone), "multi_variant_key_count": if_(kept), "observed_variant_count": F.when(alone, 1).when(kept, different).otherwise(0), "exact_repeat_count": F.when(alone, F.col("total") - 1).when(kept, F.col("total") - different).otherwise(0),
        "record_absent": if_(merged, F.lit(snapshots) - F.size("orders")), "field_absent": if_(merged, F.col("total") * F.size("names") - F.col("present")),
        "explicit_value": if_(merged, F.col("present") - F.col("explicit_null") - F.col("explicit_empty")), "explicit_null": if_(merged, F.col("explicit_null")), "explicit_empty": if_(merged, F.col("explicit_empty")),
    }
    return counters(rows, of_keys)


_STATES = ["explicit_value", "explicit_null", "explicit_empty"]
COUNTERS = ["observation_count", "null_key_hold_count", "canonical_count", "changed_count", "new_count", "previous_only_count", "reappeared_count", "updated_field_count", "single_variant_key_count", "multi_variant_key_count", "observed_variant_count", "exact_repeat_count", "record_absent", "field_absent", *_STATES]


def counters(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return rows.select("dataset", *[counts.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def summarize(counters: DataFrame) -> DataFrame:
    return counters.groupBy("dataset").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def _provenance(observations: DataFrame, daily: Column) -> DataFrame:
    """Every observation of a merged key and what became of it.

    Rows carry the names of their fields, not the values, and are sorted three times: by key and time, by key and signature, by key and place in the history. Nothing is exploded.
    """
    explicit = F.map_keys(F.map_filter("record", lambda _, v: ~v.isin("null", *_EMPTY)))
    about = ["source_object_sha256"] if "source_object_sha256" in observations.columns else []
    rows = _named(observations).where(~_nameless()).select(*KEY, "at", "export_observed_at", *about, "signature", F.array_sort(F.map_keys("record")).alias("field_presence"), explicit.alias("explicit")).repartition(*KEY)
    differ = lambda w: F.min("signature").over(w) != F.max("signature").over(w)
    at_once, equal = Window.partitionBy(*KEY, "export_observed_at"), Window.partitionBy(*KEY, "signature")
    rows = rows.withColumn("at_once", differ(at_once) & (F.min("at.snapshot_id").over(at_once) != F.max("at.snapshot_id").over(at_once))).withColumn("copies", F.count("*").over(equal))
    # within a snapshot the observations of a merged key are equal, so only the last of them can contribute
    rows = rows.withColumn("order", F.col("at.logical_order"))
    within, whole = Window.partitionBy(*KEY, "order"), Window.partitionBy(*KEY)
    rows = rows.withColumns({"within": differ(within), "latest": F.max("at").over(within) == F.col("at")})
    lasts = F.collect_set(F.when(F.col("latest"), F.struct("order", "field_presence", "explicit"))).over(whole)
    rows = rows.withColumns({"stopped": F.bool_or(F.col("within") | F.col("at_once")).over(whole), "several": differ(whole), "lasts": lasts})
    rows = rows.where(~F.col("stopped") & (~F.col("several") | ~daily))

    later = F.filter("lasts", lambda x: x["order"] > F.col("order"))
    values = F.array_except("explicit", F.flatten(later["explicit"]))
    nulls = F.array_except(F.array_except("field_presence", F.flatten(F.col("lasts.explicit"))), F.flatten(later["field_presence"]))
    contributes = F.col("latest") & ((F.size(values) > 0) | (F.size(nulls) > 0))
    disposition = F.when(contributes, "field_contributor").when(~F.col("latest") | (F.col("copies") > 1), "exact_duplicate").otherwise("superseded_record")
    places = ["at.snapshot_id", "at.logical_order", "at.source_relative_path", "at.source_record_index"]
    return rows.select(*KEY, *places, *about, F.col("signature").alias("record_sha256"), "field_presence", disposition.alias("merge_disposition"))


def merge_observations(observations: DataFrame, snapshots: int, daily: Column | None = None, preserve: Column | None = None) -> dict[str, DataFrame]:
    """The merge of the observations of any number of datasets over snapshots, as tables by name, each with ``dataset``.

    ``observations`` have ``dataset, canonical_key, snapshot_id, logical_order, export_observed_at, source_relative_path,
    source_record_index`` and ``record``, a map of field to canonical JSON. ``daily`` and ``preserve`` tell which datasets have these rules.

    * ``conflicts``: keys that emit nothing: different records within a snapshot, or of several snapshots at one time; of ``daily`` datasets different ones at all.
    * ``variants``: of ``daily`` datasets that ``preserve`` them, all different records of a key instead.
    * ``canonical``: for all other keys the presence pattern, counts and ``raw_record``: of each field the last explicit value, or the last null or empty if there is none.
    * ``field_provenance``: where each of these values is from. ``patterns``: keys by presence pattern.
    * ``provenance``: every observation of a merged key, its hash, its fields and what became of it: field_contributor, exact_duplicate or superseded_record.
    * ``holds``: rows without a key, and nulls and empties, with whether they came after a value.
    * ``summary``: counters of each dataset.
    """
    daily, preserve = (F.lit(False) if c is None else c for c in (daily, preserve))
    out = merge_collapsed(collapse(observations), snapshots, daily, preserve)
    nameless = observations.where(_nameless())
    rows = _judged(_named(observations).where(~_nameless()), "signature", "signature", daily, preserve).where("outcome = 'merged'")

    per_field = Window.partitionBy(*KEY, "field_name")
    fields = rows.select(*KEY, "at", F.explode("record").alias("field_name", "value")).withColumn("parser_state", state("value"))
    before = F.min(F.when(_explicit(), F.col("at"))).over(per_field) < F.col("at")
    fields = fields.withColumn("preserved", F.coalesce(before, F.lit(False))).where(~_explicit())
    quiet = fields.select(*KEY, "field_name", "at.snapshot_id", F.concat("parser_state", F.when(F.col("preserved"), "_preserved_previous").otherwise("_review_required")).alias("hold_type"), "at.source_relative_path", "at.source_record_index")
    none = F.lit(None).cast("string")
    holds = nameless.select("dataset", none.alias("canonical_key"), none.alias("field_name"), "snapshot_id", F.lit("null_stable_key").alias("hold_type"), "source_relative_path", "source_record_index").union(quiet)
    keys = key_rows(observations, daily, preserve)
    patterns = pattern_counts(key_rows(observations, daily, preserve, whole=False), snapshots)
    return {**{k: v for k, v in out.items() if k != "counters"}, "patterns": patterns, "provenance": _provenance(observations, daily), "holds": holds, "summary": summarize(key_counters(keys, snapshots))}


def merge_dataset(observations: DataFrame, snapshots: int, daily: bool = False, preserve: bool = False) -> dict[str, DataFrame]:
    """``merge_observations`` of a single dataset, without the column ``dataset``."""
    out = merge_observations(observations.withColumn("dataset", F.lit("")), snapshots, F.lit(daily), F.lit(preserve))
    return {name: df.drop("dataset") for name, df in out.items()}


def field_states(observations: DataFrame, fields: list[str], record: str) -> DataFrame:
    """``field, state, observation_count``: in how many observations each field is absent, null, empty or has a value."""
    each = observations.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(record)[f].alias("value")) for f in fields])).alias("e")).select("e.*")
    return each.groupBy("field", state("value").alias("state")).agg(F.count("*").cast("long").alias("observation_count"))


def current_only(observations: DataFrame, keys: list[str], order: str, snapshots: int) -> DataFrame:
    """Keys that the last snapshot has; relationships are read off these, not off all that were ever seen."""
    return observations.where(F.col(order) == snapshots).select(*keys).distinct()


def updated_fields(observations: DataFrame, keys: list[str], field: str, order: str) -> DataFrame:
    """``keys, change_count``: how often the retained value of a field changes along the snapshots."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = observations.where(F.col(field).isNotNull()).withColumn("previous", F.lag(field).over(w))
    return known.groupBy(*keys).agg(F.sum(F.when(F.col("previous") != F.col(field), 1).otherwise(0)).cast("long").alias("change_count"))


def latest(df: DataFrame, keys: list[str], by: list[str], fields: list[str]) -> DataFrame:
    """The last record of each key by ``by``, and how many it stands for; combined before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*by, *fields), F.struct(*by)).alias("best"), F.count("*").cast("long").alias("candidate_count"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*by, *fields)], "candidate_count", F.when(F.col("candidate_count") > 1, "latest_selected").otherwise("single_record").alias("dedupe_status"))
