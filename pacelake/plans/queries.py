"""The library's queries over the driver's tables: each applies an operator to a table that has the shape it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.functions import identity, times
from pacelake.operators import coverage, dedupe, digest, endpoints, matching, quality, snapshot, trends
from pacelake.plans import checks, evidence, extraction, records, synthetic
from pacelake.sources import families

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_FIELDS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _us(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _stamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- deduplication -------------------------------------------------------------


def dedupe_keyed_lineitem(spark, d):
    return dedupe.canonical(table(spark, d, "lineitem"), LINE_KEY, LINE_FIELDS).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def dedupe_variants_lineitem(spark, d):
    return dedupe.variants(table(spark, d, "lineitem"), LINE_KEY, LINE_FIELDS).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def dedupe_audit_lineitem(spark, d):
    return dedupe.audit(table(spark, d, "lineitem"), LINE_KEY, LINE_FIELDS)


def daily_conflict_null_value(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").cast("string").alias("calendar_date"), "value")
    return dedupe.agreed_value(events, ["user_id", "event_type", "calendar_date"], "value")


def duplicate_day_reflag(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("date").cast("string").alias("day"))
    return dedupe.review_duplicates(events, ["user_id", "day"]).select("event_id", "user_id", "day", "needs_review")


def latest_record_selection(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderkey", "o_totalprice")
    return snapshot.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


# --- quality and digests -------------------------------------------------------


def dataset_qa_orders(spark, d):
    return quality.dataset_qa(table(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"])


def inspect_records_lineitem(spark, d):
    return quality.inspect_records(table(spark, d, "lineitem"), LINE_KEY, LINE_FIELDS, "l_shipdate")


def digest_events(spark, d):
    events = table(spark, d, "events")
    return digest.multiset_digest(events, F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")))


def daily_projection_events(spark, d):
    return quality.daily_projection(table(spark, d, "events"), F.col("ts").cast("date"), _stamp(F.col("ts")))


def exclusion_reasons(spark, d):
    rules = [(F.col("event_type") == "error", "excluded_event_type"), (F.col("value") < 5, "value_too_small"), (F.col("value") > 200, "value_too_large")]
    events = table(spark, d, "events").withColumn("reason", F.coalesce(quality.first_reason(rules), F.lit("accepted")))
    return events.groupBy("reason").agg(F.count("*").cast("long").alias("row_count"))


def _family_rows(spark, d):
    docs = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("candidate_count"), F.sum(F.when(F.col("n_chars") < 20, 1).otherwise(0)).alias("malformed_count"), F.sum(F.when(F.col("n_chars") >= 100, 1).otherwise(0)).alias("row_count"))
    return quality.completeness(docs).select("source", "lang", F.col("candidate_count").cast("long"), F.col("malformed_count").cast("long"), F.col("row_count").cast("long"), "state", "content_validity")


def completeness_states(spark, d):
    return _family_rows(spark, d)


def state_consensus(spark, d):
    return quality.state_consensus(_family_rows(spark, d), "source")


def quality_sections(spark, d):
    orders = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.sum(F.when(F.col("o_totalprice") > 300000, 1).otherwise(0)).alias("large"))
    return orders.select("o_orderstatus", F.expr("stack(3, 'rows', rows, 'customers', customers, 'large', large) as (section, item_count)")).withColumn("item_count", F.col("item_count").cast("long"))


def privacy_scan_documents(spark, d):
    docs = table(spark, d, "documents")
    hits = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in families.PRIVACY_PATTERNS.items()])
    return docs.select("doc_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule"))


# --- snapshots -----------------------------------------------------------------


def _weekly(spark, d):
    return table(spark, d, "events").withColumn("week", F.date_trunc("week", F.col("ts").cast("timestamp")))


def _weeks(spark, d):
    """How many weeks have events."""
    return _weekly(spark, d).agg(F.count_distinct("week")).first()[0]


def _observations(spark, d):
    """The last event of each user, type and week; values under 5 count as null."""
    events = _weekly(spark, d)
    order = coverage.logical_order(events.select("week").distinct(), ["week"])
    return events.join(F.broadcast(order), "week").groupBy("user_id", "event_type", "logical_order").agg(F.max_by(F.when(F.col("value") >= 5, F.round("value", 4)), "event_id").alias("value"), F.max("event_id").alias("event_id"))


def snapshot_merge_events(spark, d):
    out = snapshot.merge_fields(_observations(spark, d), ["user_id", "event_type"], ["value", "event_id"], "logical_order", _weeks(spark, d))
    return out.select("user_id", "event_type", "value", "event_id", "presence_pattern", "source_snapshot_count", "source_observation_count", "is_new", "is_previous_only", "is_reappeared")


def _patterns(spark, d):
    return coverage.presence(_observations(spark, d), ["user_id", "event_type"], "logical_order", _weeks(spark, d))


def presence_patterns_events(spark, d):
    return coverage.flags(_patterns(spark, d)).select("user_id", "event_type", "presence_pattern", "snapshot_count", "is_new", "is_previous_only", "is_reappeared")


def presence_histogram_events(spark, d):
    return coverage.histogram(_patterns(spark, d)).select("presence_pattern", "key_count")


def coverage_prefix_events(spark, d):
    return coverage.prefixes(_patterns(spark, d), _weeks(spark, d))


def coverage_pairwise_events(spark, d):
    return coverage.pairwise(_patterns(spark, d), _weeks(spark, d))


def coverage_leave_one_out(spark, d):
    return coverage.leave_one_out(_patterns(spark, d), _weeks(spark, d))


def field_changes_events(spark, d):
    return snapshot.updated_fields(_observations(spark, d), ["user_id", "event_type"], "value", "logical_order")


def snapshot_holds_events(spark, d):
    """Events whose key is incomplete once the type ``error`` counts as empty."""
    events = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return snapshot.split_holds(events, ["user_id", "kind"])[1].select("event_id", "user_id", F.lit("null_stable_key").alias("reason"))


def snapshot_stop_conflicts(spark, d):
    """Keys of lineitem with different records under one ship date or return flag."""
    lines = table(spark, d, "lineitem").select(*LINE_KEY, F.col("l_partkey").alias("record"), "l_returnflag", F.col("l_shipdate").cast("date").alias("observed_at"))
    return snapshot.stop_conflicts(lines, LINE_KEY, "record", "l_returnflag", "observed_at")


# --- endpoints and matching ----------------------------------------------------


def endpoint_resolution_orders(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    current, cumulative = orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus in ('O', 'F')")
    found = endpoints.resolve(links, "l_orderkey", current, cumulative, orders.where("false"), F.col("l_orderkey") <= 0, "order")
    return found.groupBy("order_status", "order_authority").agg(F.count("*").cast("long").alias("link_count"), F.count_distinct("l_orderkey").cast("long").alias("order_count"))


def _links(spark, d):
    part = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    supplier = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    links = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = endpoints.resolve(links, "l_partkey", part, part, part.where("false"), None, "part")
    return endpoints.resolve(out, "l_suppkey", supplier, supplier, supplier.where("false"), None, "supplier")


def endpoint_links_promoted(spark, d):
    return endpoints.promoted(_links(spark, d), ["part", "supplier"]).select("l_partkey", "l_suppkey")


def endpoint_unresolved_reasons(spark, d):
    return endpoints.unresolved_reasons(_links(spark, d), ["part", "supplier"]).groupBy("reason").agg(F.count("*").cast("long").alias("reason_count"))


def unresolved_primary_reason(spark, d):
    return endpoints.primary_reason(endpoints.unresolved_reasons(_links(spark, d), ["part", "supplier"]))


def independent_or_linked(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return endpoints.optional_link(docs, "doc_id", table(spark, d, "labels").select("doc_id"), F.col("doc_id") == 0).select("doc_id", "source", "link_status")


def orphan_semi_anti(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def _clicks_views(spark, d):
    e = table(spark, d, "events").withColumn("us", _us("ts"))
    clicks = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("us").alias("click_us"), F.col("value").alias("click_value"))
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("us").alias("view_us"), F.col("value").alias("view_value"))
    return clicks, views


def band_join_click_view(spark, d):
    clicks, views = _clicks_views(spark, d)
    return matching.band_join(clicks, views, "click_us", "view_us", 60_000_000).select("click_id", "view_id", F.abs(F.col("click_us") - F.col("view_us")).alias("delta_us"))


def _candidates(spark, d):
    clicks, views = _clicks_views(spark, d)
    pairs = matching.band_join(clicks, views, "click_us", "view_us", 60_000_000).where(F.abs(F.col("click_value") - F.col("view_value")) <= 50)
    return pairs.select("click_id", "view_id", (F.lit(800) + F.floor((F.lit(60_000_000) - F.abs(F.col("click_us") - F.col("view_us"))) / 1_000_000)).cast("long").alias("score"))


def mutual_best_click_view(spark, d):
    return matching.mutual_best(_candidates(spark, d), "click_id", "view_id").select("click_id", "view_id", "score")


def match_residuals(spark, d):
    clicks, _ = _clicks_views(spark, d)
    found = matching.ranked(_candidates(spark, d), "click_id", "view_id")
    out = matching.residuals(clicks, "click_id", F.col("click_value") > 1, found, "left")
    return out.groupBy("outcome").agg(F.count("*").cast("long").alias("click_count"))


def relationship_coverage(spark, d):
    found = _links(spark, d)
    ok = (F.col("part_status") == "RESOLVED") & (F.col("supplier_status") == "RESOLVED")
    out = found.agg(F.count("*").cast("long").alias("eligible_count"), F.sum(ok.cast("long")).alias("link_count"), F.sum((~ok).cast("long")).alias("unresolved_count"))
    return out.withColumn("coverage", quality.coverage_ratio(F.col("link_count"), F.col("eligible_count")))


def evidence_rules_orders(spark, d):
    """The evidence rules, on pairs of one customer's orders a day apart or less (a day as a second, prices as metres)."""
    o = table(spark, d, "orders").select(F.col("o_custkey"), "o_orderkey", "o_orderpriority", (F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("long") * 1_000_000).alias("us"), "o_totalprice")
    a = o.select("o_custkey", F.col("o_orderkey").alias("left_key"), F.col("us").alias("left_us"), F.col("o_orderpriority").alias("lp"), F.col("o_totalprice").alias("lt"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("right_key"), F.col("us").alias("right_us"), F.col("o_orderpriority").alias("rp"), F.col("o_totalprice").alias("rt"))
    pairs = matching.band_join(a, b, "left_us", "right_us", 60_000_000, ["o_custkey"]).where("left_key < right_key")
    score, rule = matching.evidence_score(F.abs(F.col("left_us") - F.col("right_us")) / 1_000_000, F.col("lp") == F.col("rp"), F.abs(F.col("lt") - F.col("rt")) / 100, F.abs(F.col("lt") - F.col("rt")) / 1000)
    return pairs.select("left_key", "right_key", score.alias("score"), rule.alias("rule")).where("score is not null")


# --- joins of daily context ----------------------------------------------------


def _daily(spark, d, kind):
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("ts").cast("date").cast("string").alias("calendar_date")).agg(F.count("*").cast("long").alias("rows"), F.round(F.sum("value"), 2).alias("total"))


def full_outer_daily_context(spark, d):
    return trends.full_outer(_daily(spark, d, "signup"), _daily(spark, d, "purchase"), "calendar_date", "signup_", "purchase_")


def consistency_status(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("calendar_date"), "event_type", "value")
    a = e.where("event_type = 'click'").groupBy("user_id", "calendar_date").agg(F.count("*").alias("a_rows"), F.max("value").alias("a"))
    b = e.where("event_type = 'view'").groupBy("user_id", "calendar_date").agg(F.count("*").alias("b_rows"), F.max(F.when(F.col("value") >= 5, F.col("value"))).alias("b"))
    both = a.join(b, ["user_id", "calendar_date"], "full")
    status = (
        F.when(F.col("a_rows") > 1, "needs_review_duplicate_date").when(F.col("b_rows").isNull(), "first_only").when(F.col("a_rows").isNull(), "second_only")
        .when(F.col("a").isNull() | F.col("b").isNull(), "needs_review_missing_value").when(F.abs(F.col("a") - F.col("b")) <= 1e-9, "same_date_value_match").otherwise("same_date_value_difference")
    )
    return both.select("user_id", "calendar_date", status.alias("status"))


# --- projections ---------------------------------------------------------------


def projection_units(spark, d):
    return table(spark, d, "lineitem").select(*LINE_KEY, "l_partkey", F.round(F.col("l_extendedprice") / 100, 4).alias("distance_m"), F.round(F.col("l_quantity") / 1000, 6).alias("duration_sec"), (F.length("l_returnflag") > 0).alias("memo_present"))


def external_safe_monthly(spark, d):
    orders = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_totalprice")
    return orders.groupBy("month", "o_orderpriority").agg(F.count("*").cast("long").alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))


def private_field_presence(spark, d):
    props = F.expr("try_parse_json(props)")
    events = table(spark, d, "events").withColumn("p", props)
    return events.groupBy("event_type").agg(F.count("*").cast("long").alias("row_count"), F.sum(F.expr("CASE WHEN variant_get(p, '$.k', 'variant') IS NOT NULL THEN 1 ELSE 0 END")).cast("long").alias("k_present"), F.sum(F.expr("CASE WHEN variant_get(p, '$.deviceId', 'variant') IS NOT NULL THEN 1 ELSE 0 END")).cast("long").alias("device_present"))


def json_unnest_props(spark, d):
    return table(spark, d, "events").select(F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k")).groupBy("k").agg(F.count("*").cast("long").alias("row_count"))


def wrapper_unnest_conversations(spark, d):
    turns = table(spark, d, "conversations")
    turns = turns.withColumn("at", F.struct("turn", F.length("text"), "text"))
    return turns.groupBy("conv_id").agg(F.count("*").cast("long").alias("turn_count"), F.min("turn").cast("long").alias("first_turn"), F.max("turn").cast("long").alias("last_turn"), F.md5(F.expr("min(at) FILTER (WHERE role = 'user')")["text"]).alias("first_user_md5"), F.md5(F.expr("max(at) FILTER (WHERE role = 'assistant')")["text"]).alias("last_assistant_md5"))


def pivot_metric_types(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type", "value")
    out = e.groupBy("user_id", "day").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("value").alias("n"), F.max("value").alias("v"))
    return out.select("user_id", "day", *[F.when(F.col(f"{t}_n") == 1, F.col(f"{t}_v")).alias(f"{t}_value") for t in ("click", "view", "purchase")])


def identity_tokens(spark, d):
    c = table(spark, d, "customer")
    token = identity.identity_token(F.concat(F.lit(" 00"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", token.alias("token"), identity.keyed("customer:", token).alias("stable_key"), identity.hash_key("customer_hash:", [F.col("c_name"), F.col("c_mktsegment")]).alias("fallback_key"))


#: Sports and file names that parts are given, so that every rule of the vocabularies is met.
SPORTS = ["10", "11", "17", "Trail Running", "street", "TRAIL", "street art", "strength-training", "training", "fitness equipment", "training room", "speed-walking", "Hiking", " open water ", "", "10 km"]
FILES = ["0_summarizedActivities.json", "Gear.json", "personalRecord.json", "HillScore_1.json", "EnduranceScore_1.json", "RunRacePredictions_2.json", "1_sleepData.json", "UDSFile_3.json", "MetricsAcuteTrainingLoad_1.json", "TrainingReadinessDTO_1.json", "ActivityVo2Max_1.json", "MetricsMaxMetData_1.json", "TrainingHistory_1.json", "userBioMetrics.json", "bioMetrics_latest.json", "userBioMetricProfileData.json", "heartRateZones.json", "healthStatusData.json", "my_hillscore.json", "sleepdata.json.bak"]


def category_normalize(spark, d):
    part = table(spark, d, "part")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 19 == 18, "fit").when(F.col("p_partkey") % 23 == 22, "other").otherwise("json")
    return part.select("p_partkey", families.sport_group(pick(SPORTS)).alias("type_group"), families.classify(F.concat(F.lit("DI/x/"), pick(FILES)), kind).alias("family"))


def calendar_labels(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.floor(_us("ts") / 1000).cast("long"))
    return e.select("event_id", times.utc_day(F.col("ms")).alias("utc_day"), times.local_day(F.col("ms")).alias("local_day"), times.local_iso(F.col("ms")).alias("local_iso"))


# --- trends --------------------------------------------------------------------


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("load", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")))


def monthly_training_trends(spark, d):
    return trends.period_totals(_orders(spark, d), F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice", "load")


def weekly_trends(spark, d):
    return trends.period_totals(_orders(spark, d), F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).cast("date"), "o_totalprice", "load")


def rate_with_missing(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(*LINE_KEY, "l_partkey", F.when(F.col("l_quantity") > 25, F.col("l_extendedprice") / F.col("l_quantity")).alias("rate")).distinct()


def gap_analysis(spark, d):
    return trends.gaps(table(spark, d, "orders"), ["o_custkey"], "o_orderdate")


def first_last_segments(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return trends.first_last(orders, ["o_custkey"], ["day", "o_orderkey"], "o_totalprice", 3)


def content_blob_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size_bytes"))
    return docs.groupBy("sha256").agg(F.min("doc_id").alias("owner_id"), F.count("*").cast("long").alias("alias_count"), F.max("size_bytes").cast("long").alias("size_bytes"))


def asset_stability(spark, d):
    """Documents in one of two inventories only: those as they are, and those with one source renamed."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    after = docs.withColumn("source", F.when(F.col("source") == "src1", "moved").otherwise(F.col("source")))
    return docs.exceptAll(after).withColumn("side", F.lit("before")).union(after.exceptAll(docs).withColumn("side", F.lit("after")))


#: Queries whose results have no SQL: they read files that they generate.
GENERATED = {"fit_decode_synthetic": synthetic.fit_decode, "zip_intake_synthetic": synthetic.zip_intake, "activities_golden": synthetic.activities_golden, "run_all_synthetic": synthetic.run_all_counts}

_NAMED = [
    dedupe_keyed_lineitem, dedupe_variants_lineitem, dedupe_audit_lineitem, daily_conflict_null_value, duplicate_day_reflag, latest_record_selection,
    dataset_qa_orders, inspect_records_lineitem, digest_events, daily_projection_events, exclusion_reasons, completeness_states, state_consensus, quality_sections, privacy_scan_documents,
    snapshot_merge_events, presence_patterns_events, presence_histogram_events, coverage_prefix_events, coverage_pairwise_events, coverage_leave_one_out, field_changes_events, snapshot_holds_events, snapshot_stop_conflicts,
    endpoint_resolution_orders, endpoint_links_promoted, endpoint_unresolved_reasons, unresolved_primary_reason, independent_or_linked, orphan_semi_anti, band_join_click_view, mutual_best_click_view, match_residuals, relationship_coverage, evidence_rules_orders,
    full_outer_daily_context, consistency_status, projection_units, external_safe_monthly, private_field_presence, json_unnest_props, wrapper_unnest_conversations, pivot_metric_types, identity_tokens, category_normalize, calendar_labels,
    monthly_training_trends, weekly_trends, rate_with_missing, gap_analysis, first_last_segments, content_blob_union, asset_stability,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED} | records.QUERIES | checks.QUERIES | extraction.QUERIES | evidence.QUERIES | GENERATED
