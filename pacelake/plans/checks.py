"""Queries of integrity checks, orders, digests and snapshots of records over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.functions import identity
from pacelake.operators import coverage, digest, endpoints, integrity, quality, snapshot
from pacelake.plans import datasets
from pacelake.sources import families


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def unique_key_set(spark, d):
    return endpoints.unique_keys(_table(spark, d, "orders"), "o_orderkey")


def provenance_outside(spark, d):
    """Line items of suppliers that an inventory of suppliers in credit doesn't have."""
    inventory = _table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return integrity.outside(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), inventory, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey")


def digest_binding(spark, d):
    audits = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return integrity.bound(_table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), audits, "l_suppkey").groupBy("l_suppkey", "s_name").agg(F.count("*").alias("row_count"))


def blob_references(spark, d):
    blobs = _table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"))
    used = _table(spark, d, "documents").where("lang = 'en'").select(F.sha2("text", 256).alias("sha256"))
    return integrity.unreferenced(blobs, used, "sha256").groupBy("referenced").agg(F.count("*").alias("blob_count"))


def nested_links(spark, d):
    links = _table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = integrity.nested(links, "l_suppkey", "l_partkey", 20)
    whole = parts.groupBy("l_suppkey").agg(F.sum(F.size("rows")).alias("link_count"), F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    return whole.select("l_suppkey", "link_count", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


def totals_agree(spark, d):
    by_status = _table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return integrity.totals_agree(by_status, _table(spark, d, "orders").select(F.lit(1).alias("n")), "n")


def schema_report(spark, d):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    want = StructType().add("o_orderkey", LongType()).add("o_custkey", StringType()).add("o_totalprice", DoubleType()).add("o_clerk", StringType())
    return integrity.schema_report(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), want)


def published_order_nation(spark, d):
    """The place of each nation in the published order, in which keys count as text."""
    from pyspark.sql import Window

    nation = _table(spark, d, "nation")  # a table of fixed size, so one window may hold it
    return nation.select("n_nationkey", F.row_number().over(Window.orderBy(F.col("n_nationkey").cast("string"))).cast("long").alias("place"))


def sorted_digest_nation(spark, d):
    return digest.sorted_digest(_table(spark, d, "nation"), F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string")))


def tree_digest_documents(spark, d):
    return digest.tree_digest(_table(spark, d, "documents"), F.concat_ws("|", F.col("doc_id").cast("string"), "source", "lang"), 1)


def build_hash(spark, d):
    """The hash of a build: that of the sorted digests of what it was made of."""
    parts = [_table(spark, d, name).agg(F.sha2(F.concat_ws(":", F.lit(name), F.count("*").cast("string")), 256).alias("h")) for name in ("nation", "region", "supplier")]
    return digest.sorted_digest(parts[0].union(parts[1]).union(parts[2]), F.col("h"))


def canonical_keys(spark, d):
    o = _table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", identity.canonical_key("activities", [F.concat(F.lit("garmin_activity:"), "o_orderkey")]).alias("activity_key"), identity.canonical_key("race_prediction", [day, F.col("o_orderkey")]).alias("race_key"))


def binary_completeness(spark, d):
    kind = F.col("doc_id") % 5
    docs = _table(spark, d, "documents").groupBy("source", "lang", (F.col("doc_id") % 7).alias("slice"))
    counts = docs.agg(F.count("*").alias("candidate_count"), *[F.sum((kind == i).cast("int")).alias(f"{k}_count") for i, k in enumerate(("readable", "unreadable", "unsupported", "malformed"))], F.sum((F.col("n_chars") > 500).cast("int")).alias("row_count"))
    return quality.binary_completeness(counts).select("source", "lang", "slice", "state", "content_validity", "reason_code")


def family_rollup(spark, d):
    docs = _table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("record_count"), F.sum((F.col("n_chars") < 20).cast("int")).alias("warning_count"))
    return quality.rollup(docs, "source")


def _snapshots(spark, d) -> DataFrame:
    """Records of customers in three snapshots, by the status of their orders, the last order of each counting."""
    o = _table(spark, d, "orders").withColumn("snap", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3).cast("long"))
    last = o.groupBy("o_custkey", "snap").agg(F.max("o_orderkey").alias("k"))
    text = {"name": F.concat(F.lit('"'), F.col("k") % 5, F.lit('"')), "memo": F.when(F.col("k") % 3 == 0, '""').when(F.col("k") % 3 == 1, "null"), "load": F.when(F.col("k") % 4 == 0, "null").otherwise((F.col("k") % 7).cast("string"))}
    record = F.map_filter(F.create_map(*[x for name, v in text.items() for x in (F.lit(name), v)]), lambda _, v: v.isNotNull())
    return last.select("o_custkey", "snap", record.alias("record"))


def merge_record_fields(spark, d):
    """The merge of export records field by field: the last explicit value, and what is held for review."""
    return snapshot.merge_maps(_snapshots(spark, d), ["o_custkey"], "record", ["snap"])


def _observations(spark, d) -> DataFrame:
    """Such records as observations of a dataset, some of them twice, some without a key, some different within a snapshot or at one time."""
    s = _snapshots(spark, d).withColumn("i", F.explode(F.when((F.col("o_custkey") % 5 == 0) | (F.col("o_custkey") % 17 == 0), F.array(F.lit(10), F.lit(9))).otherwise(F.array(F.lit(10)))))
    odd = (F.col("o_custkey") % 17 == 0) & (F.col("i") == 9)
    record = F.when(odd, F.map_concat("record", F.create_map(F.lit("more"), F.lit("1")))).otherwise(F.col("record"))
    key = identity.canonical_key("uds", [F.when(F.col("o_custkey") % 31 != 0, F.col("o_custkey"))])
    return s.select(key.alias("canonical_key"), F.concat(F.lit("s"), "snap").alias("snapshot_id"), F.col("snap").alias("logical_order"), F.when(F.col("o_custkey") % 13 == 0, "t").otherwise(F.concat(F.lit("t"), "snap")).alias("export_observed_at"), F.lit("DI/uds.json").alias("source_relative_path"), F.col("i").alias("source_record_index"), record.alias("record"))


def merge_canonical(spark, d):
    out = snapshot.merge_dataset(_observations(spark, d), 3)["canonical"]
    return out.select("canonical_key", "presence_pattern", "source_snapshot_count", "source_observation_count", *[F.col("raw_record")[f].alias(f) for f in ("name", "memo", "load")])


def merge_conflicts(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3)["conflicts"]


def merge_daily_conflicts(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3, daily=True)["conflicts"].groupBy("conflict_type").agg(F.count("*").alias("key_count"))


def merge_variants(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3, daily=True, preserve=True)["variants"].select("canonical_key", "observation_count", "snapshot_orders", F.col("observed_value")["name"].alias("name"))


def merge_holds(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3)["holds"].groupBy("hold_type", "field_name", "snapshot_id").agg(F.count("*").alias("hold_count"))


def merge_field_provenance(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3)["field_provenance"].select("canonical_key", "field_name", "snapshot_id", "source_record_index")


def merge_summary(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3)["summary"]


def merge_daily_summary(spark, d):
    """Counters of a dataset whose different records are kept as variants."""
    return snapshot.merge_dataset(_observations(spark, d), 3, daily=True, preserve=True)["summary"].select("canonical_count", "single_variant_key_count", "multi_variant_key_count", "observed_variant_count", "exact_repeat_count", "null_key_hold_count", "observation_count")


def merge_provenance(spark, d):
    """Every observation of a merged key and what became of it; records of one snapshot are numbered as text, 10 before 9."""
    out = snapshot.merge_dataset(_observations(spark, d), 3)["provenance"]
    return out.select("canonical_key", "snapshot_id", "source_record_index", "record_sha256", F.array_join("field_presence", ",").alias("field_presence"), "merge_disposition")


def merge_patterns(spark, d):
    return snapshot.merge_dataset(_observations(spark, d), 3)["patterns"]


def record_field_states(spark, d):
    return snapshot.field_states(_snapshots(spark, d), ["name", "memo", "load"], "record")


def snapshot_union(spark, d):
    """All observations of the snapshots, each with its own, as one table."""
    o = _table(spark, d, "orders")
    parts = [o.where(F.col("o_orderstatus") == s).select("o_orderkey", F.lit(i).cast("long").alias("logical_order"), *(["o_totalprice"] if s != "P" else [])) for i, s in enumerate(("F", "P", "O"), 1)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def current_relationships(spark, d):
    return snapshot.current_only(_snapshots(spark, d), ["o_custkey"], "snap", 3)


def family_coverage(spark, d):
    """In which snapshots each language occurs, the sources counting as snapshots in the order of their names."""
    docs = _table(spark, d, "documents").where("lang is not null").select("lang", "source").distinct()
    order = coverage.logical_order(docs.select("source").distinct(), ["source"])
    return coverage.presence(docs.join(F.broadcast(order), "source"), ["lang"], "logical_order", order.count()).select("lang", "presence_pattern", "snapshot_count")


#: Relationships between the tables: name, from, key, to, key.
RELATIONSHIPS = [("order_customer", "orders", "o_custkey", "customer", "c_custkey"), ("line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("line_part", "lineitem", "l_partkey", "part", "p_partkey"), ("line_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("label_document", "labels", "doc_id", "documents", "doc_id")]


def relationship_projection(spark, d):
    rows = [integrity.relationship_counts(_table(spark, d, a), ka, _table(spark, d, b), kb, name) for name, a, ka, b, kb in RELATIONSHIPS]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return integrity.relationship_projection(out, [r[0] for r in RELATIONSHIPS])


def authority_reconciliation(spark, d):
    """Counts by status that were stated, with one altered, against those recomputed."""
    now = _table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return integrity.differences(now.withColumn("n", F.when(F.col("o_orderstatus") == "P", F.col("n") + 1).otherwise(F.col("n"))), now)


def family_buckets(spark, d):
    part = _table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "fit").otherwise("json")
    family = families.classify(F.concat(F.lit("DI/"), F.when(F.col("p_partkey") % 3 == 0, "gear").otherwise("UDSFile_1"), F.lit(".json")), kind)
    return part.select("p_partkey", F.explode(families.buckets(family, kind)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("file_count"))


def cumulative_dataset(spark, d):
    """A dataset of all snapshots: the merged records go through the plan of the dataset."""
    days = _table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).agg(F.min("o_orderkey").alias("k"))
    seen = days.withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("(k + i) % 3 <> 0")
    record = F.create_map(F.lit("calendarDate"), F.concat(F.lit('"'), "d", F.lit('"')), F.lit("totalSteps"), F.when((F.col("k") + F.col("i")) % 4 == 0, "null").otherwise((F.col("k") % 100 + F.col("i")).cast("string")))
    rows = seen.select(identity.canonical_key("uds", [F.col("d")]).alias("canonical_key"), F.col("i").cast("string").alias("snapshot_id"), F.col("i").cast("long").alias("logical_order"), F.col("i").cast("string").alias("export_observed_at"), F.lit("u.json").alias("source_relative_path"), F.lit(0).alias("source_record_index"), record.alias("record"))
    merged = snapshot.merge_dataset(rows, 3)["canonical"]
    source = merged.select(F.col("canonical_key").alias("provenance_path"), F.col("canonical_key").alias("sha256"), F.lit(0).alias("record_index"), F.lit(None).cast("string").alias("parent"), F.col("raw_record").alias("record"), F.lit("uds").alias("family"))
    return datasets.uds(source).records.select("calendar_date", "steps")


_SNAP = """
    o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS snap, o_orderkey FROM orders),
    s AS (SELECT o_custkey, snap, max(o_orderkey) AS k FROM o GROUP BY ALL),
    f AS (SELECT o_custkey, snap, 'name' AS field, '"' || (k % 5) || '"' AS value FROM s UNION ALL SELECT o_custkey, snap, 'memo', CASE k % 3 WHEN 0 THEN '""' WHEN 1 THEN 'null' END FROM s UNION ALL SELECT o_custkey, snap, 'load', CASE WHEN k % 4 = 0 THEN 'null' ELSE (k % 7)::VARCHAR END FROM s),
    g AS (SELECT *, CASE WHEN value IS NULL THEN 'field_absent' WHEN value = 'null' THEN 'explicit_null' WHEN value = '""' THEN 'explicit_empty' ELSE 'explicit_value' END AS state FROM f)"""

_MERGE = (
    _SNAP
    + """,
    n0 AS (SELECT *, unnest(CASE WHEN o_custkey % 5 = 0 OR o_custkey % 17 = 0 THEN [10, 9] ELSE [10] END) AS i FROM s),
    n AS (SELECT o_custkey AS c, CASE WHEN o_custkey % 31 <> 0 THEN 'uds:' || sha256('["' || o_custkey || '"]') END AS key, snap, i, CASE WHEN o_custkey % 13 = 0 THEN 't' ELSE 't' || snap END AS seen, '"' || (k % 5) || '"' AS name, CASE k % 3 WHEN 0 THEN '""' WHEN 1 THEN 'null' END AS memo,
          CASE WHEN k % 4 = 0 THEN 'null' ELSE (k % 7)::VARCHAR END AS load, CASE WHEN o_custkey % 17 = 0 AND i = 9 THEN '1' END AS more FROM n0),
    sg AS (SELECT *, concat_ws('|', name, coalesce(memo, '-'), load, coalesce(more, '-')) AS sig FROM n WHERE key IS NOT NULL),
    stops AS (SELECT key, 'divergent_duplicate_within_snapshot' AS conflict_type, snap::VARCHAR AS found_at FROM sg GROUP BY key, snap HAVING count(DISTINCT sig) > 1 UNION ALL SELECT key, 'same_observation_time_different_value', seen FROM sg GROUP BY key, seen HAVING count(DISTINCT sig) > 1 AND count(DISTINCT snap) > 1),
    ok AS (SELECT *, count(DISTINCT sig) OVER (PARTITION BY key) > 1 AS several FROM sg WHERE key NOT IN (SELECT key FROM stops)),
    fl AS (SELECT key, snap, i, 'name' AS field_name, name AS value FROM ok UNION ALL SELECT key, snap, i, 'memo', memo FROM ok WHERE memo IS NOT NULL UNION ALL SELECT key, snap, i, 'load', load FROM ok UNION ALL SELECT key, snap, i, 'more', more FROM ok WHERE more IS NOT NULL),
    fs AS (SELECT *, CASE WHEN value = 'null' THEN 'explicit_null' WHEN value = '""' THEN 'explicit_empty' ELSE 'explicit_value' END AS state FROM fl),
    fp AS (SELECT *, state <> 'explicit_value' AND coalesce(bool_or(state = 'explicit_value') OVER (PARTITION BY key, field_name ORDER BY snap, i::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS preserved FROM fs),
    kept AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY key, field_name ORDER BY snap, i::VARCHAR) <> value, false) AS changed FROM fp WHERE NOT preserved),
    lst AS (SELECT key, field_name, arg_max(value, snap * 2 + (i = 9)::INT) AS value, arg_max(snap, snap * 2 + (i = 9)::INT) AS snap, arg_max(i, snap * 2 + (i = 9)::INT) AS i, sum(changed::INT) AS updates FROM kept GROUP BY ALL),
    pr AS (SELECT key, string_agg(CASE WHEN has THEN '1' ELSE '0' END, '' ORDER BY x) AS pat, count(*) FILTER (WHERE has) AS snaps FROM (SELECT key, x, bool_or(snap = x) AS has FROM ok, range(1, 4) t(x) GROUP BY ALL) GROUP BY key),
    ct AS (SELECT key, count(*) AS obs, bool_or(several) AS changed FROM ok GROUP BY key)"""
)

_REL = " UNION ALL ".join(
    f"SELECT '{name}' AS relationship_id, count(a.{ka})::BIGINT AS eligible_count, count(*) FILTER (WHERE n = 1)::BIGINT AS explicit_link_count, count(*) FILTER (WHERE a.{ka} IS NOT NULL AND n IS NULL)::BIGINT AS unresolved_count, count(*) FILTER (WHERE n > 1)::BIGINT AS ambiguous_count, false AS inference_performed FROM {a} a LEFT JOIN (SELECT {kb} AS k, count(*) AS n FROM {b} GROUP BY 1) b ON b.k = a.{ka}"
    for name, a, ka, b, kb in RELATIONSHIPS
)

SQL = {
    "relationship_projection": _REL,
    "authority_reconciliation": "SELECT 'P' AS o_orderstatus, count(*)::BIGINT AS n, 'recomputed' AS side FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'P', count(*)::BIGINT + 1, 'stated' FROM orders WHERE o_orderstatus = 'P'",
    "family_buckets": "SELECT bucket, count(*)::BIGINT AS file_count FROM (SELECT unnest(CASE WHEN p_partkey % 4 = 0 THEN ['fit', 'hrv'] WHEN p_partkey % 3 = 0 THEN ['gear'] ELSE ['uds'] END) AS bucket FROM part) GROUP BY 1",
    "cumulative_dataset": """WITH x AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, min(o_orderkey) AS k FROM orders GROUP BY 1), y AS (SELECT d, k, unnest([1, 2, 3]) AS i FROM x)
        SELECT d AS calendar_date, arg_max(k % 100 + i, i) FILTER (WHERE (k + i) % 4 <> 0)::DOUBLE AS steps FROM y WHERE (k + i) % 3 <> 0 GROUP BY d""",
    "merge_canonical": f"""WITH {_MERGE} SELECT key AS canonical_key, pat AS presence_pattern, snaps::BIGINT AS source_snapshot_count, obs::BIGINT AS source_observation_count, a.value AS name, b.value AS memo, c.value AS load
        FROM pr JOIN ct USING (key) LEFT JOIN (SELECT * FROM lst WHERE field_name = 'name') a USING (key) LEFT JOIN (SELECT * FROM lst WHERE field_name = 'memo') b USING (key) LEFT JOIN (SELECT * FROM lst WHERE field_name = 'load') c USING (key)""",
    "merge_conflicts": f"WITH {_MERGE} SELECT key AS canonical_key, conflict_type, found_at FROM stops",
    "merge_daily_conflicts": f"""WITH {_MERGE} SELECT conflict_type, count(*)::BIGINT AS key_count FROM (SELECT key, conflict_type FROM stops UNION ALL SELECT DISTINCT key, 'same_stable_key_different_public_value' FROM ok WHERE several) GROUP BY 1""",
    "merge_variants": f"WITH {_MERGE} SELECT key AS canonical_key, count(*)::BIGINT AS observation_count, string_agg(DISTINCT snap::VARCHAR, ',' ORDER BY snap::VARCHAR) AS snapshot_orders, min(name) AS name FROM ok WHERE several GROUP BY key, sig",
    "merge_holds": f"""WITH {_MERGE} SELECT hold_type, field_name, 's' || snap AS snapshot_id, count(*)::BIGINT AS hold_count FROM (SELECT 'null_stable_key' AS hold_type, NULL AS field_name, snap FROM n WHERE key IS NULL UNION ALL SELECT state || CASE WHEN preserved THEN '_preserved_previous' ELSE '_review_required' END, field_name, snap FROM fp WHERE state <> 'explicit_value') GROUP BY ALL""",
    "merge_field_provenance": f"WITH {_MERGE} SELECT key AS canonical_key, field_name, 's' || snap AS snapshot_id, i AS source_record_index FROM lst",
    "merge_summary": f"""WITH {_MERGE}, u AS (SELECT key, count(DISTINCT field_name) AS universe FROM fl GROUP BY 1), c AS (SELECT count(*)::BIGINT AS canonical_count, count(*) FILTER (WHERE changed)::BIGINT AS changed_count, count(*) FILTER (WHERE regexp_matches(pat, '^0*1$'))::BIGINT AS new_count, count(*) FILTER (WHERE pat LIKE '%0')::BIGINT AS previous_only_count, count(*) FILTER (WHERE regexp_matches(pat, '10+1'))::BIGINT AS reappeared_count,
        count(*) FILTER (WHERE NOT changed)::BIGINT AS single_variant_key_count, 0::BIGINT AS multi_variant_key_count, count(*) FILTER (WHERE NOT changed)::BIGINT AS observed_variant_count, coalesce(sum(obs - 1) FILTER (WHERE NOT changed), 0)::BIGINT AS exact_repeat_count, sum(3 - snaps)::BIGINT AS record_absent, sum(obs * universe)::BIGINT AS cells FROM pr JOIN ct USING (key) JOIN u USING (key))
        SELECT * EXCLUDE (cells), cells - (SELECT count(*) FROM fs)::BIGINT AS field_absent, (SELECT count(*) FROM n)::BIGINT AS observation_count, (SELECT count(*) FROM n WHERE key IS NULL)::BIGINT AS null_key_hold_count, (SELECT sum(updates) FROM lst)::BIGINT AS updated_field_count,
        (SELECT count(*) FROM fs WHERE state = 'explicit_value')::BIGINT AS explicit_value, (SELECT count(*) FROM fs WHERE state = 'explicit_null')::BIGINT AS explicit_null, (SELECT count(*) FROM fs WHERE state = 'explicit_empty')::BIGINT AS explicit_empty FROM c""",
    "merge_daily_summary": f"""WITH {_MERGE}, k AS (SELECT key, any_value(several) AS several, count(DISTINCT sig) AS sigs, count(*) AS obs FROM ok GROUP BY 1)
        SELECT count(*) FILTER (WHERE NOT several)::BIGINT AS canonical_count, count(*) FILTER (WHERE NOT several)::BIGINT AS single_variant_key_count, count(*) FILTER (WHERE several)::BIGINT AS multi_variant_key_count, sum(sigs)::BIGINT AS observed_variant_count, sum(obs - sigs)::BIGINT AS exact_repeat_count, (SELECT count(*) FROM n WHERE key IS NULL)::BIGINT AS null_key_hold_count, (SELECT count(*) FROM n)::BIGINT AS observation_count FROM k""",
    "merge_provenance": f"""WITH {_MERGE}, s2 AS (SELECT *, count(*) OVER (PARTITION BY key, sig) AS copies FROM ok),
        used AS (SELECT DISTINCT key, snap, i FROM lst)
        SELECT s2.key AS canonical_key, 's' || s2.snap AS snapshot_id, s2.i AS source_record_index,
            sha256('{{"load":' || load || CASE WHEN memo IS NULL THEN '' ELSE ',"memo":' || memo END || CASE WHEN more IS NULL THEN '' ELSE ',"more":1' END || ',"name":' || name || '}}') AS record_sha256,
            concat_ws(',', 'load', CASE WHEN memo IS NOT NULL THEN 'memo' END, CASE WHEN more IS NOT NULL THEN 'more' END, 'name') AS field_presence,
            CASE WHEN used.key IS NOT NULL THEN 'field_contributor' WHEN copies > 1 THEN 'exact_duplicate' ELSE 'superseded_record' END AS merge_disposition
        FROM s2 LEFT JOIN used ON used.key = s2.key AND used.snap = s2.snap AND used.i = s2.i""",
    "merge_patterns": f"WITH {_MERGE} SELECT pat AS presence_pattern, count(*)::BIGINT AS key_count FROM pr GROUP BY 1",
    "unique_key_set": "SELECT o_orderkey FROM orders",
    "provenance_outside": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)",
    "digest_binding": "SELECT l_suppkey, s_name, count(*)::BIGINT AS row_count FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "blob_references": "SELECT referenced, count(*)::BIGINT AS blob_count FROM (SELECT text, coalesce(bool_or(lang = 'en'), false) AS referenced FROM documents WHERE text IS NOT NULL GROUP BY text) GROUP BY 1",
    "nested_links": "SELECT l_suppkey, count(*)::BIGINT AS link_count, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS rows FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1",
    "totals_agree": "SELECT count(*)::BIGINT AS part_sum, count(*)::BIGINT AS total, true AS agree FROM orders",
    "schema_report": "SELECT * FROM (VALUES ('o_clerk', 'string', NULL, false), ('o_custkey', 'string', 'bigint', false), ('o_orderkey', 'bigint', 'bigint', true), ('o_orderstatus', NULL, 'string', false), ('o_totalprice', 'double', 'double', true)) t(column_name, expected, actual, matches)",
    "published_order_nation": "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey::VARCHAR)::BIGINT AS place FROM nation",
    "sorted_digest_nation": "SELECT count(*)::BIGINT AS row_count, sha256(string_agg(n_name || ':' || n_nationkey, chr(10) ORDER BY n_name || ':' || n_nationkey)) AS digest FROM nation",
    "tree_digest_documents": """WITH h AS (SELECT sha256(concat_ws('|', doc_id::VARCHAR, source, lang)) AS h FROM documents), l AS (SELECT substr(h, 1, 2) AS leaf, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS row_count, sha256(string_agg(d, chr(10) ORDER BY leaf)) AS digest FROM l""",
    "build_hash": """WITH p AS (SELECT sha256('nation:' || count(*)) AS h FROM nation UNION ALL SELECT sha256('region:' || count(*)) FROM region UNION ALL SELECT sha256('supplier:' || count(*)) FROM supplier) SELECT count(*)::BIGINT AS row_count, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM p""",
    "canonical_keys": """SELECT o_orderkey, 'garmin_activity:' || o_orderkey AS activity_key, CASE WHEN o_orderkey % 10 <> 0 THEN 'race_prediction:' || sha256('["' || strftime(o_orderdate, '%Y-%m-%d') || '","' || o_orderkey || '"]') END AS race_key FROM orders""",
    "binary_completeness": """WITH c AS (SELECT source, lang, doc_id % 7 AS slice, count(*) AS n, count(*) FILTER (WHERE doc_id % 5 = 0) AS a, count(*) FILTER (WHERE doc_id % 5 = 1) AS b, count(*) FILTER (WHERE doc_id % 5 = 2) AS c, count(*) FILTER (WHERE doc_id % 5 = 3) AS e, count(*) FILTER (WHERE n_chars > 500) AS r FROM documents GROUP BY ALL),
        s AS (SELECT *, CASE WHEN a + b + c + e <> n THEN 'FIT_CLASSIFICATION_INCOMPLETE' WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (e > 0)::INT > 1 THEN 'MIXED_FIT_EVIDENCE' WHEN b > 0 THEN 'FIT_NOT_READABLE' WHEN c > 0 THEN 'FIT_FORM_UNSUPPORTED' WHEN e > 0 OR r > 0 THEN 'FIT_EVIDENCE_PRESENT' ELSE 'SOURCE_STRUCTURALLY_EMPTY' END AS reason_code FROM c)
        SELECT source, lang, slice, CASE reason_code WHEN 'FIT_NOT_READABLE' THEN 'UNREADABLE' WHEN 'FIT_FORM_UNSUPPORTED' THEN 'UNSUPPORTED' WHEN 'FIT_EVIDENCE_PRESENT' THEN 'PRESENT' WHEN 'SOURCE_STRUCTURALLY_EMPTY' THEN 'EMPTY' ELSE 'AMBIGUOUS' END AS state,
            CASE WHEN reason_code IN ('FIT_CLASSIFICATION_INCOMPLETE', 'MIXED_FIT_EVIDENCE', 'FIT_NOT_READABLE') THEN 'UNKNOWN' WHEN reason_code = 'FIT_FORM_UNSUPPORTED' THEN 'NOT_APPLICABLE' WHEN e > 0 THEN 'MALFORMED' ELSE 'VALID' END AS content_validity, reason_code FROM s""",
    "family_rollup": """SELECT source, count(*)::BIGINT AS dataset_count, sum(n)::BIGINT AS record_count, sum(w)::BIGINT AS warning_count, CASE WHEN sum(w) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM (SELECT source, lang, count(*) AS n, coalesce(count(*) FILTER (WHERE n_chars < 20), 0) AS w FROM documents GROUP BY ALL) GROUP BY 1""",
    "merge_record_fields": f"""WITH {_SNAP}, m AS (SELECT o_custkey, field, arg_max(value, snap) FILTER (WHERE state = 'explicit_value') AS known, arg_max(value, snap) AS last, arg_max(state, snap) AS last_state, count(*)::BIGINT AS n FROM g WHERE value IS NOT NULL GROUP BY ALL)
        SELECT o_custkey, field, coalesce(known, last) AS value, n AS observation_count, CASE WHEN last_state = 'explicit_value' THEN NULL WHEN known IS NOT NULL THEN last_state || '_preserved_previous' ELSE last_state || '_review_required' END AS held FROM m""",
    "record_field_states": f"WITH {_SNAP} SELECT field, state, count(*)::BIGINT AS observation_count FROM g GROUP BY ALL",
    "snapshot_union": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END::BIGINT AS logical_order, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders",
    "current_relationships": f"WITH {_SNAP} SELECT o_custkey FROM s WHERE snap = 3",
    "family_coverage": """WITH o AS (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM documents WHERE lang IS NOT NULL)), x AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL), l AS (SELECT DISTINCT lang FROM x)
        SELECT l.lang, string_agg(CASE WHEN x.lang IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS presence_pattern, count(x.lang)::BIGINT AS snapshot_count FROM l, o LEFT JOIN x ON x.lang = l.lang AND x.source = o.source GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
