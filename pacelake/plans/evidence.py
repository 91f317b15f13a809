"""Queries of threshold candidates, completeness by snapshot, collisions of names, privacy rules, build digests, review rows and incremental merges, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.operators import dedupe, digest, quality, snapshot, stage
from pacelake.plans import checks, health
from pacelake.sources import families
from pacelake.streaming import incremental


def _table(spark, d, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- threshold candidates -----------------------------------------------------------------

_POWER = "CASE k % 9 WHEN 0 THEN '\"high\"' WHEN 1 THEN 'null' WHEN 2 THEN NULL ELSE CAST(200 + k % 7 AS STRING) END"
_SPEED = "CASE WHEN k % 6 = 0 THEN 'true' WHEN k % 6 = 1 THEN '0' END"
_META = "CASE k % 8 WHEN 0 THEN 'null' WHEN 1 THEN '{\"calendarDate\":\"soon\"}' ELSE '{\"calendarDate\":\"' || d || 'T00:00:00\",\"sequence\":' || (k % 5) || '}' END"
_METHOD = "CASE k % 3 WHEN 0 THEN '\"LACTATE_THRESHOLD\"' WHEN 1 THEN '\"HR_MAX\"' END"


def _thresholds(spark, d) -> dict[str, DataFrame]:
    o = _table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c", "date_format(o_orderdate, 'yyyy-MM-dd') AS d")
    fields = {"functionalThresholdPower": _POWER, "lactateThresholdSpeed": _SPEED, "metaData": _META, "trainingMethod": _METHOD}
    record = F.map_filter(F.create_map(*[x for n, e in fields.items() for x in (F.lit(n), F.expr(e).cast("string"))]), lambda _, v: v.isNotNull())
    family = F.element_at(F.array(*map(F.lit, health.THRESHOLD_FAMILIES)), (F.col("c") % 4 + 1).cast("int"))
    return health.collect_thresholds(o.select(family.alias("observation_family"), record.alias("record")))


def threshold_candidates(spark, d):
    """Different candidates of the four families with their place; repeated ones are one."""
    return _thresholds(spark, d)["candidates"].select("observation_family", F.coalesce("observation_timestamp", F.lit("")).alias("observation_timestamp"), F.coalesce("functional_threshold_power", F.lit(-1.0)).alias("power"), F.coalesce("lactate_threshold_speed", F.lit(-1.0)).alias("speed"), F.coalesce("lactate_threshold_type", F.lit("")).alias("kind"), "place")


def threshold_reviews(spark, d):
    """Review conditions that the same objects meet."""
    return _thresholds(spark, d)["reviews"]


_THRESHOLDS = f"""
    b AS (SELECT o_orderkey AS k, ['history', 'latest_snapshot', 'profile_state', 'derived_evidence'][o_custkey % 4 + 1] AS f, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
    r AS (SELECT *, {_POWER} AS pj, {_SPEED} AS sj, CASE WHEN f = 'history' AND k % 8 = 0 THEN 'history_metadata_missing' WHEN f = 'history' AND k % 8 = 1 THEN 'history_timestamp_missing_or_invalid' END AS stop FROM b),
    n AS (SELECT *, TRY_CAST(pj AS DOUBLE) AS power, CASE WHEN sj = '0' THEN 0::DOUBLE END AS speed, CASE WHEN f = 'history' THEN d END AS t, CASE WHEN f = 'history' THEN k % 5 ELSE 0 END AS seq, CASE WHEN f = 'derived_evidence' AND k % 3 = 0 THEN 'LACTATE_THRESHOLD' END AS kind FROM r),
    u AS (SELECT f, t, power, speed, kind, min(seq) AS seq FROM n WHERE stop IS NULL AND (power IS NOT NULL OR speed IS NOT NULL OR kind IS NOT NULL) GROUP BY ALL)"""

# --- completeness, collisions, privacy ---------------------------------------------------------

# Families of sources in the order of reports.
FAMILIES = ["activities", "gear", "personal_records", "fit", "hill_score", "endurance_score", "race_prediction", "sleep", "uds", "acute_training_load", "training_readiness", "vo2max", "training_history"]


def completeness_consensus(spark, d):
    """One state for each family over all snapshots, ambiguous where they differ; every reason is listed."""
    return quality.state_consensus(completeness_by_snapshot(spark, d), "family")


def completeness_by_snapshot(spark, d):
    """Every family in every snapshot (a source of documents stands for one), those without a file as absent; no pair of state and validity may be wrong."""
    docs = _table(spark, d, "documents").where("source IS NOT NULL")
    kind = F.col("doc_id") % 4
    counts = docs.where("n_chars % 3 <> 0").groupBy(F.col("source").alias("snapshot_id"), F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("n_chars") % 13 + 1).cast("int")).alias("family"))
    counts = counts.agg(F.count("*").alias("candidate_count"), F.sum(F.when(F.col("n_chars") > 1500, 1).otherwise(0)).alias("row_count"), *[F.sum((kind == i).cast("int")).alias(c) for i, c in enumerate(quality.BINARY_COUNTS)])
    out = quality.snapshot_completeness(counts, docs.select(F.col("source").alias("snapshot_id")).distinct(), FAMILIES)
    wrong = quality.invalid_states(out)
    return out.join(wrong.select("family", "snapshot_id"), ["family", "snapshot_id"], "left_anti")


def name_collisions(spark, d):
    """Names that differ only in case or in how an accent is written."""
    name = F.expr("concat('DI/', CASE p_partkey % 4 WHEN 0 THEN 'R\u00e9' WHEN 1 THEN 'Ré' WHEN 2 THEN 'r\u00c9' ELSE 'other' END, CAST(p_partkey DIV 8 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '.JSON' ELSE '.json' END)")
    return families.name_collisions(_table(spark, d, "part").select(name.alias("path")), "path").select("folded_path", "path_count")


def privacy_rules(spark, d):
    """How many pages, documents and turns of conversations break each rule."""
    texts = _table(spark, d, "documents").select(F.lit("documents").alias("kind"), "text").union(_table(spark, d, "conversations").select(F.lit("conversations"), "text")).union(_table(spark, d, "pages").select(F.lit("pages"), F.concat(F.col("url"), F.lit(" "), F.col("html"))))
    return families.privacy_findings(texts, "text").groupBy("kind", "rule").agg(F.count("*").alias("finding_count"))


#: RE2 has no look-behind; the numbers of the rule are bounded by a character that isn't one of theirs, or by an end.
_NUMBERS = r"(^|[^0-9A-Fa-f])([0-9]{10}|[0-9]{13})([^0-9A-Fa-f]|$)"


def _rule_sql() -> str:
    parts = []
    for name, pattern in families.PRIVACY_RULES.items():
        p = pattern if name != "share_or_instant" else r"(\\\\[^\\\r\n]+\\[^\\\r\n]+|\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}|" + _NUMBERS + ")"
        parts.append(f"SELECT kind, '{name}' AS rule, count(*)::BIGINT AS finding_count FROM t WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') GROUP BY 1")
    return "WITH t AS (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', url || ' ' || html FROM pages) " + " UNION ALL ".join(parts)


# --- builds, review rows, incremental merges -------------------------------------------------


def build_records(spark, d):
    """The digest of a build: its merged records, its variants, what it was made of, and the versions of what made it."""
    out = snapshot.merge_dataset(checks._observations(spark, d), 3, daily=True, preserve=True)
    records = out["canonical"].select(F.lit("uds").alias("dataset"), "canonical_key", snapshot.signature("raw_record").alias("record_sha256"), "presence_pattern")
    variants = out["variants"].select(F.lit("uds").alias("dataset"), "canonical_key", "signature", "snapshot_orders")
    contents = _table(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("content_id"))
    return digest.build_digest(records, variants, contents, {"schema": "1", "parser": "2"})


def dedupe_review(spark, d):
    """Parts of orders that several suppliers deliver: where a key has two origins a review row stands for it, without a winner."""
    rows = _table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 5).alias("value"), F.lit("available").alias("status"), (F.col("l_suppkey") % 2).alias("origin"))
    return dedupe.reviewed(rows, ["l_orderkey"], ["value", "status"], ["origin"], {"value": F.lit(-1).cast("long"), "status": F.lit("needs_review")})


def variant_lineage(spark, d):
    """Clerks' orders with different values under one customer and status: each variant with its fingerprint and the months that hold it."""
    rows = _table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3).alias("value"), F.month("o_orderdate").cast("long").alias("logical_order"))
    return dedupe.traced_variants(rows, ["o_custkey", "o_orderstatus"], ["value"], "logical_order").withColumn("value", F.coalesce("value", F.lit(-1)))


def incremental_merge(spark, d):
    """Snapshots absorbed as batches, the last one first: the merge of all at once."""
    rows = checks._observations(spark, d).withColumn("dataset", F.lit("uds"))
    path = f"{stage.folder(spark)}/{uuid.uuid4().hex}"
    for batch, order in enumerate((3, 1, 2)):
        incremental.absorb(rows.where(F.col("logical_order") == order).drop("logical_order"), batch, path)
    incremental.compact(spark, path)
    out = incremental.current(spark, path)["canonical"]
    return out.select("canonical_key", "presence_pattern", "source_snapshot_count", "source_observation_count", *[F.col("raw_record")[f].alias(f) for f in ("name", "memo", "load")])


_COMPLETENESS = f"""WITH x AS (SELECT *, {FAMILIES!r}[n_chars % 13 + 1] AS family FROM documents WHERE source IS NOT NULL AND n_chars % 3 <> 0),
        c AS (SELECT source, family, count(*) AS n, count(*) FILTER (WHERE n_chars > 1500) AS r, count(*) FILTER (WHERE doc_id % 4 = 0) AS a, count(*) FILTER (WHERE doc_id % 4 = 1) AS b, count(*) FILTER (WHERE doc_id % 4 = 2) AS u, count(*) FILTER (WHERE doc_id % 4 = 3) AS m FROM x GROUP BY ALL),
        g AS (SELECT s.source, f.family, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(u, 0) AS u, coalesce(m, 0) AS m FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s CROSS JOIN (SELECT unnest({FAMILIES!r}) AS family) f LEFT JOIN c ON c.source = s.source AND c.family = f.family),
        k AS (SELECT *, family = 'fit' AS fit, (a > 0)::INT + (b > 0)::INT + (u > 0)::INT + (m > 0)::INT AS kinds FROM g),
        t AS (SELECT *, CASE WHEN n = 0 THEN 'ABSENT' WHEN fit AND kinds > 1 THEN 'AMBIGUOUS' WHEN fit AND b > 0 THEN 'UNREADABLE' WHEN fit AND u > 0 THEN 'UNSUPPORTED' WHEN m > 0 OR r > 0 THEN 'PRESENT' ELSE 'EMPTY' END AS state FROM k)
        SELECT family, source AS snapshot_id, state, CASE WHEN state IN ('ABSENT', 'UNSUPPORTED') THEN 'NOT_APPLICABLE' WHEN state IN ('AMBIGUOUS', 'UNREADABLE') THEN 'UNKNOWN' WHEN state = 'PRESENT' AND m > 0 THEN 'MALFORMED' ELSE 'VALID' END AS content_validity,
            CASE state WHEN 'ABSENT' THEN 'SOURCE_NOT_OBSERVED' WHEN 'EMPTY' THEN 'SOURCE_STRUCTURALLY_EMPTY' WHEN 'AMBIGUOUS' THEN 'MIXED_FIT_EVIDENCE' WHEN 'UNREADABLE' THEN 'FIT_NOT_READABLE' WHEN 'UNSUPPORTED' THEN 'FIT_FORM_UNSUPPORTED' ELSE CASE WHEN fit THEN 'FIT_EVIDENCE_PRESENT' ELSE 'SOURCE_EVIDENCE_PRESENT' END END AS reason_code,
            n::BIGINT AS candidate_count, CASE WHEN fit THEN a ELSE n END::BIGINT AS readable_asset_count, r::BIGINT AS row_count,
            CASE state WHEN 'PRESENT' THEN 'CONSULT_CONTENT_VALIDITY_AND_RUN_QUALITY' WHEN 'EMPTY' THEN 'SUPPORTED_SOURCE_CONTAINED_ZERO_OBSERVATIONS' WHEN 'ABSENT' THEN 'DO_NOT_INFER_ZERO_OR_DELETION' WHEN 'UNREADABLE' THEN 'OBTAIN_COMPLETE_READABLE_EXPORT' WHEN 'UNSUPPORTED' THEN 'SOURCE_FORM_NOT_SUPPORTED_BY_THIS_VERSION' ELSE 'REVIEW_REQUIRED_NO_WINNER_SELECTED' END AS user_guidance_id FROM t"""

_LEAF = "sha256(string_agg(h, chr(10) ORDER BY h))"

SQL = {
    "threshold_candidates": f"""WITH {_THRESHOLDS} SELECT f AS observation_family, coalesce(t, '') AS observation_timestamp, coalesce(power, -1) AS power, coalesce(speed, -1) AS speed, coalesce(kind, '') AS kind,
        row_number() OVER (PARTITION BY f, t ORDER BY seq, speed NULLS FIRST, power NULLS FIRST, kind NULLS FIRST)::INTEGER AS place FROM u""",
    "threshold_reviews": f"""WITH {_THRESHOLDS}, c AS (SELECT stop AS condition FROM n WHERE stop IS NOT NULL UNION ALL SELECT 'invalid_functional_threshold_power' FROM n WHERE stop IS NULL AND k % 9 = 0 UNION ALL SELECT 'invalid_lactate_threshold_speed' FROM n WHERE stop IS NULL AND k % 6 = 0
        UNION ALL SELECT 'functional_threshold_power_conflict' FROM (SELECT 1 FROM u GROUP BY f, t HAVING count(DISTINCT power) > 1)) SELECT condition, count(*)::BIGINT AS review_count FROM c GROUP BY 1""",
    "completeness_by_snapshot": _COMPLETENESS,
    "completeness_consensus": f"""WITH s AS ({_COMPLETENESS}) SELECT family, CASE WHEN count(DISTINCT (state, content_validity)) = 1 THEN min(state) ELSE 'AMBIGUOUS' END AS state, CASE WHEN count(DISTINCT (state, content_validity)) = 1 THEN min(content_validity) ELSE 'UNKNOWN' END AS content_validity,
        sum(row_count)::BIGINT AS row_count, string_agg(DISTINCT state, ',' ORDER BY state) AS states, string_agg(DISTINCT reason_code, ',' ORDER BY reason_code) AS reason_codes FROM s GROUP BY 1""",
    "name_collisions": """WITH p AS (SELECT DISTINCT 'DI/' || CASE p_partkey % 4 WHEN 0 THEN 'R\u00e9' WHEN 1 THEN 'Ré' WHEN 2 THEN 'r\u00c9' ELSE 'other' END || (p_partkey // 8) || CASE WHEN p_partkey % 3 = 0 THEN '.JSON' ELSE '.json' END AS path FROM part) SELECT lower(nfc_normalize(path)) AS folded_path, count(*)::BIGINT AS path_count FROM p GROUP BY 1 HAVING count(*) > 1""",
    "privacy_rules": _rule_sql(),
    "build_records": f"""WITH {checks._MERGE}, s2 AS (SELECT *, sha256('{{"load":' || load || CASE WHEN memo IS NULL THEN '' ELSE ',"memo":' || memo END || CASE WHEN more IS NULL THEN '' ELSE ',"more":1' END || ',"name":' || name || '}}') AS rec FROM ok),
        m AS (SELECT DISTINCT '["uds","' || s2.key || '","' || rec || '","' || pat || '"]' AS t FROM s2 JOIN pr USING (key) WHERE NOT several),
        v AS (SELECT '["uds","' || key || '","' || rec || '","' || string_agg(DISTINCT snap::VARCHAR, ',' ORDER BY snap::VARCHAR) || '"]' AS t FROM s2 WHERE several GROUP BY key, rec),
        l AS (SELECT sha256(t) AS h FROM (SELECT t FROM m UNION ALL SELECT t FROM v)), c AS (SELECT sha256('c' || n_nationkey) AS h FROM nation)
        SELECT (SELECT count(*) FROM l)::BIGINT AS record_count, (SELECT count(*) FROM c)::BIGINT AS content_count, sha256('["parser=2","schema=1"]' || chr(10) || (SELECT {_LEAF} FROM l) || chr(10) || (SELECT {_LEAF} FROM c)) AS digest""",
    "dedupe_review": """SELECT l_orderkey, CASE WHEN two THEN -1 ELSE l_orderkey % 5 END::BIGINT AS value, CASE WHEN two THEN 'needs_review' ELSE 'available' END AS status, two AS review_required FROM (SELECT l_orderkey, count(DISTINCT l_suppkey % 2) > 1 AS two FROM lineitem GROUP BY 1)""",
    "variant_lineage": """WITH v AS (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 END AS value, count(*)::BIGINT AS observation_count,
            list_sort(list(DISTINCT month(o_orderdate))) AS months FROM orders GROUP BY 1, 2, 3)
        SELECT o_custkey, o_orderstatus, coalesce(value, -1)::BIGINT AS value, observation_count, array_to_string(months, ',') AS snapshot_orders, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","value":' || coalesce(value::VARCHAR, 'null') || '}') AS variant_fingerprint,
            'unresolved_multiple_observed_values' AS canonical_status FROM v QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1""",
    "incremental_merge": checks.SQL["merge_canonical"],
}

QUERIES = {name: globals()[name] for name in SQL}
