"""SQL that gives the same rows as each query."""

from __future__ import annotations

from pacelake.plans import checks, evidence, extraction, records
from pacelake.plans.queries import FILES, GENERATED, LINE_FIELDS, LINE_KEY, SPORTS, queries
from pacelake.sources.families import FAMILY_RULES, PRIVACY_PATTERNS

_KEY, _FIELDS = ", ".join(LINE_KEY), ", ".join(LINE_FIELDS)
_OUT = _FIELDS.replace("l_shipdate", "l_shipdate::DATE AS l_shipdate")
_EACH = f"SELECT {_KEY}, {_FIELDS}, count(*)::BIGINT AS observation_count FROM lineitem GROUP BY {_KEY}, {_FIELDS}"

_OBS = """
    w AS (SELECT *, date_trunc('week', ts)::DATE AS week FROM events),
    o AS (SELECT week, row_number() OVER (ORDER BY week)::BIGINT AS ord FROM (SELECT DISTINCT week FROM w)),
    e AS (SELECT w.*, o.ord FROM w JOIN o USING (week)),
    obs AS (SELECT user_id, event_type, ord, CASE WHEN value >= 5 THEN round(value, 4) END AS value, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ord ORDER BY event_id DESC) = 1)"""
_PAT = (
    _OBS
    + """,
    pat AS (SELECT user_id, event_type, string_agg(CASE WHEN n IN (SELECT unnest(ords)) THEN '1' ELSE '0' END, '' ORDER BY n) AS presence_pattern, len(ANY_VALUE(ords))::BIGINT AS snapshot_count
            FROM (SELECT user_id, event_type, list(ord) AS ords FROM obs GROUP BY ALL) x, range(1, 6) r(n) GROUP BY user_id, event_type)"""
).replace("CASE WHEN n IN (SELECT unnest(ords)) THEN", "CASE WHEN list_contains(ords, n) THEN")
_FLAGS = "regexp_matches(presence_pattern, '^0*1$') AS is_new, presence_pattern LIKE '%0' AS is_previous_only, regexp_matches(presence_pattern, '10+1') AS is_reappeared"

_LINKS = """
    l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
    s AS (SELECT l.*, p.p_partkey IS NOT NULL AS part_ok, s.s_suppkey IS NOT NULL AS supp_ok
          FROM l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) p ON p_partkey = l_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey),
    reasons AS (SELECT 'part_unresolved_valid_link' AS reason FROM s WHERE NOT part_ok UNION ALL SELECT 'supplier_unresolved_valid_link' FROM s WHERE NOT supp_ok)"""

_CAND = """
    c AS (SELECT event_id AS click_id, epoch_us(ts) AS us, value AS v FROM events WHERE event_type = 'click'),
    b AS (SELECT event_id AS view_id, epoch_us(ts) AS us, value AS v FROM events WHERE event_type = 'view'),
    cand AS (SELECT click_id, view_id, (800 + floor((60000000 - abs(c.us - b.us)) / 1000000.0))::BIGINT AS score FROM c JOIN b ON b.us BETWEEN c.us - 60000000 AND c.us + 60000000 WHERE abs(c.v - b.v) <= 50),
    bc AS (SELECT click_id, max(score) AS top, count(*) FILTER (WHERE score = m) AS n FROM (SELECT *, max(score) OVER (PARTITION BY click_id) AS m FROM cand) GROUP BY click_id),
    bv AS (SELECT view_id, max(score) AS top, count(*) FILTER (WHERE score = m) AS n FROM (SELECT *, max(score) OVER (PARTITION BY view_id) AS m FROM cand) GROUP BY view_id),
    links AS (SELECT cand.* FROM cand JOIN bc ON cand.click_id = bc.click_id AND score = bc.top AND bc.n = 1 JOIN bv ON cand.view_id = bv.view_id AND score = bv.top AND bv.n = 1)"""

_FAMILY = """
    SELECT *, CASE WHEN candidate_count = 0 THEN 'ABSENT' WHEN malformed_count > 0 OR row_count > 0 THEN 'PRESENT' ELSE 'EMPTY' END AS state,
           CASE WHEN candidate_count = 0 THEN 'NOT_APPLICABLE' WHEN malformed_count > 0 THEN 'MALFORMED' ELSE 'VALID' END AS content_validity
    FROM (SELECT source, lang, count(*)::BIGINT AS candidate_count, count(*) FILTER (WHERE n_chars < 20)::BIGINT AS malformed_count, count(*) FILTER (WHERE n_chars >= 100)::BIGINT AS row_count FROM documents GROUP BY source, lang)"""


def _periods(period: str) -> str:
    return f"""SELECT {period} AS period, count(*)::BIGINT AS activity_count, round(sum(o_totalprice), 2) AS total_amount, count(load)::BIGINT AS observed_count, count(*) FILTER (WHERE load IS NULL)::BIGINT AS missing_count
        FROM (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS load FROM orders) GROUP BY 1"""


def _family_case(name: str) -> str:
    tests = " ".join(f"WHEN {'ends_with' if how == 'ends' else 'starts_with'}({name}, '{text}') THEN '{family}'" for text, how, family in FAMILY_RULES)
    return f"CASE {tests} ELSE 'unclassified' END"


_SQL = {
    "dedupe_keyed_lineitem": f"SELECT {_KEY}, {_OUT} FROM ({_EACH}) QUALIFY count(*) OVER (PARTITION BY {_KEY}) = 1",
    "dedupe_variants_lineitem": f"SELECT {_KEY}, {_OUT}, observation_count FROM ({_EACH}) QUALIFY count(*) OVER (PARTITION BY {_KEY}) > 1",
    "dedupe_audit_lineitem": f"""SELECT sum(n)::BIGINT AS source_record_count, count(*)::BIGINT AS key_count, sum(n - v)::BIGINT AS same_value_duplicates, count(*) FILTER (WHERE v > 1)::BIGINT AS multi_variant_key_count,
        coalesce(sum(v) FILTER (WHERE v > 1), 0)::BIGINT AS variant_count, CASE WHEN count(*) FILTER (WHERE v > 1) > 0 THEN 'PASS_WITH_REVIEW_ITEMS' ELSE 'PASS' END AS status FROM (SELECT {_KEY}, sum(observation_count) AS n, count(*) AS v FROM ({_EACH}) GROUP BY {_KEY})""",
    "daily_conflict_null_value": """SELECT user_id, event_type, calendar_date, CASE WHEN lo = hi THEN lo END AS value, n AS record_count,
        CASE WHEN lo <> hi THEN 'review_required_same_day_differing_values' WHEN lo IS NULL THEN 'no_valid_value_for_date' WHEN n > 1 THEN 'same_date_same_value_deduped' ELSE 'single_value' END AS dedupe_status
        FROM (SELECT user_id, event_type, ts::DATE::VARCHAR AS calendar_date, min(value) AS lo, max(value) AS hi, count(*)::BIGINT AS n FROM events GROUP BY ALL)""",
    "duplicate_day_reflag": "SELECT event_id, user_id, ts::DATE::VARCHAR AS day, count(*) OVER (PARTITION BY user_id, ts::DATE) > 1 AS needs_review FROM events",
    "latest_record_selection": """SELECT o_custkey, o_orderdate::DATE AS o_orderdate, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey)::BIGINT AS candidate_count, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'latest_selected' ELSE 'single_record' END AS dedupe_status
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1""",
    "dataset_qa_orders": """SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_extra_rows, 0::BIGINT AS missing_key_rows, count(*) FILTER (WHERE v > 1)::BIGINT AS divergent_key_count
        FROM (SELECT o_orderkey, count(*) AS n, count(DISTINCT (o_custkey, o_orderstatus, o_totalprice)) AS v FROM orders GROUP BY o_orderkey)""",
    "inspect_records_lineitem": f"""SELECT 0::BIGINT AS null_key_rows, count(*) FILTER (WHERE n > 1)::BIGINT AS duplicate_key_groups, count(*) FILTER (WHERE n > 1 AND v = 1)::BIGINT AS exact_duplicate_groups,
        count(*) FILTER (WHERE v > 1 AND t = v)::BIGINT AS ordered_update_groups, count(*) FILTER (WHERE v > 1 AND t <> v)::BIGINT AS unresolved_conflict_groups,
        CASE WHEN count(*) FILTER (WHERE v > 1 AND t <> v) > 0 THEN 'FAIL_UNRESOLVED_CONFLICT' WHEN count(*) FILTER (WHERE v > 1 AND t = v) > 0 THEN 'PASS_WITH_ORDERED_UPDATES' ELSE 'PASS' END AS status
        FROM (SELECT {_KEY}, sum(observation_count) AS n, count(*) AS v, count(DISTINCT l_shipdate) AS t FROM ({_EACH}) GROUP BY {_KEY})""",
    "digest_events": """SELECT n AS row_count, sha256(n::VARCHAR || ':' || total::VARCHAR) AS digest FROM (SELECT count(*)::BIGINT AS n, sum(('0x' || substr(sha256(event_id::VARCHAR || '|' || event_type || '|' || user_id::VARCHAR), 1, 15))::BIGINT)::HUGEINT AS total FROM events)""",
    "daily_projection_events": """SELECT count(*)::BIGINT AS date_count, count(*) FILTER (WHERE n > 1)::BIGINT AS multi_observation_date_count, max(n)::BIGINT AS max_observations_per_date, min(lo) AS first_observation, max(hi) AS last_observation
        FROM (SELECT ts::DATE AS d, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS lo, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS hi FROM events GROUP BY 1)""",
    "exclusion_reasons": "SELECT CASE WHEN event_type = 'error' THEN 'excluded_event_type' WHEN value < 5 THEN 'value_too_small' WHEN value > 200 THEN 'value_too_large' ELSE 'accepted' END AS reason, count(*)::BIGINT AS row_count FROM events GROUP BY 1",
    "completeness_states": _FAMILY,
    "state_consensus": f"""SELECT source, CASE WHEN count(DISTINCT (state, content_validity)) = 1 THEN min(state) ELSE 'AMBIGUOUS' END AS state, CASE WHEN count(DISTINCT (state, content_validity)) = 1 THEN min(content_validity) ELSE 'UNKNOWN' END AS content_validity,
        sum(row_count)::BIGINT AS row_count, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM ({_FAMILY}) GROUP BY source""",
    "quality_sections": """WITH q AS (SELECT o_orderstatus, count(*)::BIGINT AS a, count(DISTINCT o_custkey)::BIGINT AS b, count(*) FILTER (WHERE o_totalprice > 300000)::BIGINT AS c FROM orders GROUP BY 1)
        SELECT o_orderstatus, 'rows' AS section, a AS item_count FROM q UNION ALL SELECT o_orderstatus, 'customers', b FROM q UNION ALL SELECT o_orderstatus, 'large', c FROM q""",
    "privacy_scan_documents": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM documents WHERE regexp_matches(text, '{p}')" for n, p in PRIVACY_PATTERNS.items()),
    "snapshot_merge_events": f"""WITH {_PAT}
        SELECT user_id, event_type, arg_max(value, ord) FILTER (WHERE value IS NOT NULL) AS value, arg_max(event_id, ord)::BIGINT AS event_id, ANY_VALUE(presence_pattern) AS presence_pattern, ANY_VALUE(snapshot_count) AS source_snapshot_count, count(*)::BIGINT AS source_observation_count,
               regexp_matches(ANY_VALUE(presence_pattern), '^0*1$') AS is_new, ANY_VALUE(presence_pattern) LIKE '%0' AS is_previous_only, regexp_matches(ANY_VALUE(presence_pattern), '10+1') AS is_reappeared
        FROM obs JOIN pat USING (user_id, event_type) GROUP BY user_id, event_type""",
    "presence_patterns_events": f"WITH {_PAT} SELECT user_id, event_type, presence_pattern, snapshot_count, {_FLAGS} FROM pat",
    "presence_histogram_events": f"WITH {_PAT} SELECT presence_pattern, count(*)::BIGINT AS key_count FROM pat GROUP BY 1",
    "coverage_prefix_events": f"""WITH {_OBS}, f AS (SELECT user_id, event_type, min(ord) AS first FROM obs GROUP BY ALL)
        SELECT n::BIGINT AS logical_order, count(*) FILTER (WHERE first = n)::BIGINT AS new_keys, count(*) FILTER (WHERE first <= n)::BIGINT AS cumulative_keys FROM f, range(1, 6) r(n) GROUP BY n""",
    "coverage_pairwise_events": f"""WITH {_PAT} SELECT l::BIGINT AS left_order, r::BIGINT AS right_order, count(*) FILTER (WHERE a)::BIGINT AS left_count, count(*) FILTER (WHERE b)::BIGINT AS right_count, count(*) FILTER (WHERE a AND b)::BIGINT AS overlap_count,
        count(*) FILTER (WHERE a AND NOT b)::BIGINT AS left_only_count, count(*) FILTER (WHERE b AND NOT a)::BIGINT AS right_only_count
        FROM (SELECT l, r, substr(presence_pattern, l, 1) = '1' AS a, substr(presence_pattern, r, 1) = '1' AS b FROM pat, range(1, 6) x(l), range(1, 6) y(r) WHERE l < r) GROUP BY l, r""",
    "coverage_leave_one_out": f"""WITH {_PAT} SELECT n::BIGINT AS logical_order, count(*) FILTER (WHERE snapshot_count = 1 AND substr(presence_pattern, n, 1) = '1')::BIGINT AS unique_keys FROM pat, range(1, 6) r(n) GROUP BY n""",
    "field_changes_events": f"""WITH {_OBS} SELECT user_id, event_type, count(*) FILTER (WHERE p <> value)::BIGINT AS change_count FROM (SELECT user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ord) AS p FROM obs WHERE value IS NOT NULL) GROUP BY ALL""",
    "snapshot_holds_events": "SELECT event_id, user_id, 'null_stable_key' AS reason FROM events WHERE event_type = 'error'",
    "snapshot_stop_conflicts": f"""WITH a AS (SELECT DISTINCT {_KEY} FROM (SELECT {_KEY}, l_returnflag FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1)),
        b AS (SELECT DISTINCT {_KEY} FROM (SELECT {_KEY}, l_shipdate::DATE FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1))
        SELECT {_KEY}, min(reason) AS reason FROM (SELECT *, 'different_records_within_snapshot' AS reason FROM a UNION ALL SELECT *, 'different_records_at_one_time' FROM b) GROUP BY {_KEY}""",
    "endpoint_resolution_orders": """SELECT CASE WHEN l_orderkey <= 0 THEN 'MALFORMED' WHEN o_orderstatus IN ('O', 'F') THEN 'RESOLVED' ELSE 'UNRESOLVED_VALID_LINK' END AS order_status, CASE WHEN l_orderkey <= 0 THEN 'none' WHEN o_orderstatus = 'O' THEN 'current' WHEN o_orderstatus = 'F' THEN 'snapshot' ELSE 'none' END AS order_authority,
        count(*)::BIGINT AS link_count, count(DISTINCT l_orderkey)::BIGINT AS order_count FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "endpoint_links_promoted": f"WITH {_LINKS} SELECT l_partkey, l_suppkey FROM s WHERE part_ok AND supp_ok",
    "endpoint_unresolved_reasons": f"WITH {_LINKS} SELECT reason, count(*)::BIGINT AS reason_count FROM reasons GROUP BY 1",
    "unresolved_primary_reason": f"WITH {_LINKS} SELECT reason, count(*)::BIGINT AS reason_count FROM reasons GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "independent_or_linked": "SELECT d.doc_id, source, CASE WHEN d.doc_id = 0 THEN 'independent' WHEN l.doc_id IS NOT NULL THEN 'linked' ELSE 'unresolved' END AS link_status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
    "orphan_semi_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "band_join_click_view": f"WITH {_CAND} SELECT click_id, view_id, abs(c.us - b.us)::BIGINT AS delta_us FROM c JOIN b ON b.us BETWEEN c.us - 60000000 AND c.us + 60000000",
    "mutual_best_click_view": f"WITH {_CAND} SELECT click_id, view_id, score FROM links",
    "match_residuals": f"""WITH {_CAND} SELECT CASE WHEN l.click_id IS NOT NULL THEN 'linked' WHEN c.v <= 1 THEN 'excluded' WHEN bc.n IS NULL THEN 'no_evidence_qualified_candidate' WHEN bc.n > 1 THEN 'ambiguous_candidate' ELSE 'one_to_one_conflict' END AS outcome, count(*)::BIGINT AS click_count
        FROM c LEFT JOIN links l USING (click_id) LEFT JOIN bc ON bc.click_id = c.click_id GROUP BY 1""",
    "relationship_coverage": f"WITH {_LINKS} SELECT count(*)::BIGINT AS eligible_count, count(*) FILTER (WHERE part_ok AND supp_ok)::BIGINT AS link_count, count(*) FILTER (WHERE NOT (part_ok AND supp_ok))::BIGINT AS unresolved_count, round(count(*) FILTER (WHERE part_ok AND supp_ok) / count(*), 6) AS coverage FROM s",
    "evidence_rules_orders": """WITH p AS (SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key, abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) AS dt, a.o_orderpriority = b.o_orderpriority AS sport, abs(a.o_totalprice - b.o_totalprice) AS dp
            FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 60),
        n AS (SELECT *, sport::INT + (dp / 100 <= 200)::INT + (dp / 1000 <= 5)::INT AS n FROM p)
        SELECT left_key, right_key, CASE WHEN dt = 0 AND n > 0 THEN 1000 + 100 * n ELSE 800 + 60 - dt END::BIGINT AS score, CASE WHEN dt = 0 AND n > 0 THEN 'exact_start_with_corroboration' ELSE 'near_start_exact_metrics' END AS rule
        FROM n WHERE (dt = 0 AND n > 0) OR (sport AND dp / 100 <= 1 AND dp / 1000 <= 1)""",
    "full_outer_daily_context": """WITH s AS (SELECT ts::DATE::VARCHAR AS calendar_date, count(*)::BIGINT AS signup_rows, round(sum(value), 2) AS signup_total FROM events WHERE event_type = 'signup' GROUP BY 1),
        p AS (SELECT ts::DATE::VARCHAR AS calendar_date, count(*)::BIGINT AS purchase_rows, round(sum(value), 2) AS purchase_total FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT * FROM s FULL JOIN p USING (calendar_date)""",
    "consistency_status": """WITH a AS (SELECT user_id, ts::DATE::VARCHAR AS calendar_date, count(*) AS a_rows, max(value) AS a FROM events WHERE event_type = 'click' GROUP BY 1, 2),
        b AS (SELECT user_id, ts::DATE::VARCHAR AS calendar_date, count(*) AS b_rows, max(value) FILTER (WHERE value >= 5) AS b FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT user_id, calendar_date, CASE WHEN a_rows > 1 THEN 'needs_review_duplicate_date' WHEN b_rows IS NULL THEN 'first_only' WHEN a_rows IS NULL THEN 'second_only' WHEN a IS NULL OR b IS NULL THEN 'needs_review_missing_value'
            WHEN abs(a - b) <= 1e-9 THEN 'same_date_value_match' ELSE 'same_date_value_difference' END AS status FROM a FULL JOIN b USING (user_id, calendar_date)""",
    "projection_units": f"SELECT {_KEY}, l_partkey, round(l_extendedprice / 100, 4) AS distance_m, round(l_quantity / 1000, 6) AS duration_sec, length(l_returnflag) > 0 AS memo_present FROM lineitem",
    "external_safe_monthly": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, count(*)::BIGINT AS order_count, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1, 2",
    "private_field_presence": "SELECT event_type, count(*)::BIGINT AS row_count, count(*) FILTER (WHERE json_exists(props, '$.k'))::BIGINT AS k_present, count(*) FILTER (WHERE json_exists(props, '$.deviceId'))::BIGINT AS device_present FROM events GROUP BY 1",
    "json_unnest_props": "SELECT (props->>'$.k')::BIGINT AS k, count(*)::BIGINT AS row_count FROM events GROUP BY 1",
    "wrapper_unnest_conversations": """SELECT conv_id, count(*)::BIGINT AS turn_count, min(turn)::BIGINT AS first_turn, max(turn)::BIGINT AS last_turn,
        md5(first(text ORDER BY turn, length(text), text) FILTER (WHERE role = 'user')) AS first_user_md5, md5(last(text ORDER BY turn, length(text), text) FILTER (WHERE role = 'assistant')) AS last_assistant_md5 FROM conversations GROUP BY 1""",
    "pivot_metric_types": """SELECT user_id, ts::DATE::VARCHAR AS day, """
    + ", ".join(f"CASE WHEN count(value) FILTER (WHERE event_type = '{t}') = 1 THEN max(value) FILTER (WHERE event_type = '{t}') END AS {t}_value" for t in ("click", "view", "purchase"))
    + " FROM events GROUP BY 1, 2",
    "identity_tokens": """SELECT c_custkey, t AS token, 'customer:' || t AS stable_key, 'customer_hash:' || substr(sha256('["' || c_name || '","' || c_mktsegment || '"]'), 1, 24) AS fallback_key FROM (SELECT *, nullif(c_custkey::VARCHAR, '0') AS t FROM customer)""",
    "category_normalize": f"""SELECT p_partkey, CASE WHEN s = '10' THEN 'strength_training' WHEN s = '11' THEN 'walking' WHEN s = '17' THEN 'hiking' WHEN s LIKE '%run%' OR s IN ('street', 'trail') THEN 'running'
            WHEN s LIKE '%strength%' OR s IN ('training', 'fitness_equipment') THEN 'strength_training' WHEN s LIKE '%walk%' THEN 'walking' WHEN s LIKE '%hik%' THEN 'hiking' WHEN s = '' THEN NULL ELSE s END AS type_group,
        CASE WHEN p_partkey % 19 = 18 THEN 'fit' WHEN p_partkey % 23 = 22 THEN 'unclassified' ELSE {_family_case("n")} END AS family
        FROM (SELECT p_partkey, replace(replace(lower(trim(list_extract({SPORTS!r}, (p_partkey % {len(SPORTS)} + 1)::INT))), '-', '_'), ' ', '_') AS s, lower(list_extract({FILES!r}, (p_partkey % {len(FILES)} + 1)::INT)) AS n FROM part)""",
    "calendar_labels": """SELECT event_id, strftime(u, '%Y-%m-%d') AS utc_day, strftime(l, '%Y-%m-%d') AS local_day, strftime(l, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 <> 0 THEN '.' || lpad(((ms % 1000) * 1000)::VARCHAR, 6, '0') ELSE '' END || '+09:00' AS local_iso
        FROM (SELECT event_id, ms, make_timestamp(ms * 1000) AS u, make_timestamp(ms * 1000) + INTERVAL 9 HOUR AS l FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events))""",
    "monthly_training_trends": _periods("strftime(o_orderdate, '%Y-%m')"),
    "weekly_trends": _periods("date_trunc('week', o_orderdate)::DATE"),
    "rate_with_missing": f"SELECT DISTINCT {_KEY}, l_partkey, CASE WHEN l_quantity > 25 THEN l_extendedprice / l_quantity END AS rate FROM lineitem",
    "gap_analysis": "SELECT o_custkey, count(*)::BIGINT AS date_count, max(gap)::BIGINT AS max_gap_days, round(avg(gap), 4) AS mean_gap_days FROM (SELECT o_custkey, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap FROM (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders)) GROUP BY 1",
    "first_last_segments": """SELECT o_custkey, round(avg(o_totalprice) FILTER (WHERE i <= 3), 4) AS first_mean, round(avg(o_totalprice) FILTER (WHERE j <= 3), 4) AS last_mean
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS j FROM orders) GROUP BY 1""",
    "content_blob_union": "SELECT sha256(text) AS sha256, min(doc_id) AS owner_id, count(*)::BIGINT AS alias_count, max(octet_length(encode(text)))::BIGINT AS size_bytes FROM documents GROUP BY 1",
    "asset_stability": "SELECT doc_id, source, 'before' AS side FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 'moved', 'after' FROM documents WHERE source = 'src1'",
}


def oracle_sql() -> dict[str, str]:
    missing = set(queries()) - set(_SQL) - set(records.SQL) - set(checks.SQL) - set(extraction.SQL) - set(evidence.SQL) - set(GENERATED)
    if missing:
        raise KeyError(f"no SQL for {sorted(missing)}")
    return _SQL | records.SQL | checks.SQL | extraction.SQL | evidence.SQL
