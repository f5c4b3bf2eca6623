"""Oracle SQL of the ingestion operators."""

from __future__ import annotations

from tidemark.plans.oracle_marts import BODIES as MARTS
from tidemark.sources.contracts import CONTRACTS

_COLUMNS = CONTRACTS["subscription_transactions"].columns
_CODES = {
    "attempted_at": "CASE WHEN NOT regexp_full_match(attempted_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') THEN 'INVALID_TIMESTAMP' END",
    "billing_period": "CASE WHEN billing_period NOT IN ('monthly', 'annual') THEN 'INVALID_DOMAIN' END",
    "amount_gbp": "CASE WHEN amount_gbp = '' THEN 'NULL_NOT_ALLOWED' WHEN amount_gbp <> trim(amount_gbp) THEN 'SURROUNDING_WHITESPACE' END",
    "billing_cycle_number": "CASE WHEN NOT regexp_full_match(billing_cycle_number, '-?(0|[1-9][0-9]*)') THEN 'INVALID_INTEGER' END",
    "attempt_number": "CASE WHEN attempt_number NOT IN ('1', '2') THEN 'OUT_OF_RANGE' END",
}
_TYPED = ("transaction_id, subscription_id, user_id, installation_id, transaction_type, "
          "CASE WHEN c_attempted_at IS NULL THEN strptime(attempted_at, '%Y-%m-%dT%H:%M:%SZ') END AS attempted_at, billing_period, "
          "CASE WHEN c_amount_gbp IS NULL THEN CAST(amount_gbp AS DOUBLE) END AS amount_gbp, currency, payment_status, "
          "CASE WHEN c_billing_cycle_number IS NULL THEN CAST(billing_cycle_number AS BIGINT) END AS billing_cycle_number, CAST(attempt_number AS BIGINT) AS attempt_number")


def _tag(kind: str, text: str) -> str:
    return f"""'["{kind}","' || {text} || '"]'"""


def _field(name: str, value: str) -> str:
    return f"""'["{name}",' || {value} || ']'"""


_TS = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ')"
_TXN = ["transaction_id", "subscription_id", "user_id", "installation_id", "transaction_type"]
_PAYLOAD = """'{"dataset":"subscription_transactions","fields":[' || """ + " || ',' || ".join(
    [_field(c, _tag("string", c)) for c in _TXN]
    + [_field("attempted_at", _tag("timestamp", _TS.format(c="attempted_at"))), _field("billing_period", _tag("string", "billing_period")),
       _field("amount_gbp", _tag("decimal", "CASE WHEN amount_gbp = 0 THEN '0' ELSE regexp_replace(regexp_replace(CAST(CAST(amount_gbp AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') END"))]
    + [_field(c, _tag("string", c)) for c in ("currency", "payment_status")]
    + [_field(c, _tag("integer", f"CAST({c} AS VARCHAR)")) for c in ("billing_cycle_number", "attempt_number")]) + " || ']}'"
_USER_TS = "CASE WHEN {c} IS NULL THEN '[\"null\",null]' ELSE " + _tag("timestamp", _TS) + " END"
_USER_PAYLOAD = """'{"dataset":"users","fields":[' || """ + " || ',' || ".join(
    [_field(c, _tag("integer", f"CAST({c} AS VARCHAR)")) for c in ("user_id", "installation_id")] + [_field("anonymous_id", _tag("string", "anonymous_id"))]
    + [_field(c, _USER_TS.format(c=c)) for c in ("signed_up_at", "onboarding_started_at", "onboarding_completed_at")]) + " || ']}'"

SHARED: dict[str, str] = {
    "i_raw": """
SELECT concat_ws('_', 'txn', l_orderkey, l_linenumber, l_partkey) AS transaction_id, concat_ws('_', 'sub', l_orderkey) AS subscription_id,
  concat_ws('_', 'usr', o_custkey) AS user_id, concat_ws('_', 'ins', o_custkey) AS installation_id,
  CASE WHEN l_linenumber = 1 THEN 'initial_charge' ELSE 'renewal' END AS transaction_type,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS attempted_at,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'annual' WHEN o_orderpriority = '5-LOW' THEN 'weekly' ELSE 'monthly' END AS billing_period,
  CASE WHEN l_tax = 0.08 THEN '' WHEN l_discount = 0.05 THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount_gbp,
  'GBP' AS currency, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS payment_status,
  CASE WHEN l_linenumber = 3 THEN '03' ELSE CAST(l_linenumber AS VARCHAR) END AS billing_cycle_number,
  CASE WHEN l_quantity > 45 THEN '3' ELSE '1' END AS attempt_number
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "i_parsed": "SELECT *, concat_ws('|', " + ", ".join(f"c_{c}" for c in _CODES) + ") AS error_codes, concat_ws('|', "
    + ", ".join(f"'{c}:' || c_{c}" for c in _CODES) + ") AS error_details FROM (SELECT *, " + ", ".join(f"{e} AS c_{c}" for c, e in _CODES.items()) + " FROM i_raw)",
    "i_accepted": f"SELECT {_TYPED} FROM i_parsed WHERE error_codes = ''",
    "i_gate": """
SELECT ingestion_batch_id, read_row_count, accepted_row_count, rejected_row_count, run, reason IS NULL AS promoted, reason AS refused_because,
  CASE WHEN reason IS NULL THEN accepted_row_count ELSE 0 END AS promoted_row_count
FROM (SELECT *, CASE WHEN ingestion_batch_id % 10 > 1 THEN ingestion_batch_id * 10 + 2 END AS run,
    CASE WHEN rejected_row_count > 0 THEN 'rejected_rows' WHEN ingestion_batch_id % 10 = 0 THEN 'not_validated' WHEN ingestion_batch_id % 10 = 1 THEN 'validation_failed' END AS reason
  FROM (SELECT CAST(substr(subscription_id, 5) AS BIGINT) AS ingestion_batch_id, count(*) AS read_row_count, count(*) FILTER (WHERE error_codes = '') AS accepted_row_count,
    count(*) FILTER (WHERE error_codes <> '') AS rejected_row_count FROM i_parsed GROUP BY 1))""",
    "i_batches": "SELECT *, CAST(year(subscription_started_at) AS BIGINT) AS ingestion_batch_id FROM paid_subscriptions",
    "i_digest": "SELECT dataset, count(*) AS n, CAST(sum(b) AS VARCHAR) AS s, CAST(bit_xor(b) AS VARCHAR) AS x FROM (SELECT dataset, ('0x' || substr(h, 1, 15))::BIGINT AS b FROM ("
    f"SELECT 'subscription_transactions' AS dataset, sha256({_PAYLOAD}) AS h FROM i_accepted UNION ALL SELECT 'users', sha256({_USER_PAYLOAD}) FROM users)) GROUP BY 1",
}

_MANIFEST = {
    "country_funnel": MARTS["country_funnel"], "platform_funnel": MARTS["platform_funnel"],
    "retention_by_billing": MARTS["retention_by_billing"], "daily_feature_engagement": MARTS["daily_feature_engagement"],
}
_MANIFEST_COLUMNS = {
    "country_funnel": "country_code,install_to_signup_rate,installation_count,installations_with_signup",
    "platform_funnel": "install_to_signup_rate,installation_count,installations_with_signup,platform",
    "retention_by_billing": ",".join(sorted(["billing_period", "paid_subscription_count", *[
        x for n in (30, 90, 180, 365) for x in (f"mature_d{n}_count", f"retained_d{n}_count", f"paid_retention_d{n}")]])),
    "daily_feature_engagement": "date_key,feature_installation_count,feature_name,feature_session_count,feature_use_event_count,feature_user_count,full_date",
}

BODIES: dict[str, str] = {
    "scan_contract": "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in _COLUMNS) + " FROM i_raw",
    "snapshot_audit": """SELECT 'subscription_transactions' AS dataset, 'present' AS status, count(*) AS row_count, CAST(0 AS BIGINT) AS malformed_count FROM i_raw
UNION ALL SELECT 'users', 'missing', 0, 0 UNION ALL SELECT 'regions', 'unexpected', 0, 0""",
    "table_fingerprint": "SELECT count(*) AS dataset_count, CAST(sum(n) AS BIGINT) AS row_count, 'raw_' || sha256(string_agg(concat_ws(':', dataset, CAST(n AS VARCHAR), s, x), chr(10) ORDER BY dataset)) AS snapshot_id FROM i_digest",
    "typed_cast": f"SELECT {_TYPED}, error_codes FROM i_parsed",
    "accepted_rows": "SELECT * FROM i_accepted",
    "quarantine_rows": "SELECT 'subscription_transactions' AS dataset_name, error_codes, error_details, '{' || "
    + " || ',' || ".join(f"""'"{c}":"' || {c} || '"'""" for c in sorted(_COLUMNS)) + " || '}' AS raw_record_json FROM i_parsed WHERE error_codes <> ''",
    "row_hash": f"SELECT transaction_id, sha256({_PAYLOAD}) AS row_hash FROM i_accepted",
    "new_batches_only": """SELECT ingestion_batch_id, count(*) AS row_count, max(subscription_started_at) AS last_started_at FROM i_batches
WHERE ingestion_batch_id >= (SELECT max(ingestion_batch_id) - 1 FROM i_batches) GROUP BY 1""",
    "load_snapshot": f"""SELECT CAST(20240131 AS BIGINT) AS ingestion_batch_id, 'snapshot_a' AS snapshot_id, 'subscription_transactions' AS dataset_name, count(*) FILTER (WHERE error_codes = '') AS accepted_row_count,
  count(*) FILTER (WHERE error_codes <> '') AS rejected_row_count, 'succeeded' AS status, (SELECT count(*) FROM i_accepted) AS stored_row_count,
  (SELECT count(DISTINCT sha256({_PAYLOAD})) FROM i_accepted) AS distinct_row_hashes, 'already_loaded' AS second_attempt FROM i_parsed
UNION ALL SELECT 20240131, 'snapshot_a', 'users', count(*), 0, 'succeeded', count(*), count(*), 'already_loaded' FROM users""",
    "load_reconciliation": """SELECT 'subscription_transactions' AS dataset_name, count(*) AS read_row_count, count(*) FILTER (WHERE error_codes = '') AS accepted_row_count,
  count(*) FILTER (WHERE error_codes <> '') AS rejected_row_count, (SELECT count(*) FROM i_accepted) AS loaded_row_count, true AS reconciled FROM i_parsed""",
    "promote_batch": """SELECT transaction_id, CAST(year(attempted_at) AS BIGINT) AS ingestion_batch_id, CAST(year(attempted_at) * 10 AS BIGINT) AS validation_run_id, amount_gbp FROM i_accepted""",
    "scan_records": """SELECT doc_id AS note_id, sha256(coalesce(text, '')) AS body_sha256, nullif(source, '') AS source, false AS malformed, true AS after_header,
  true AS numbers_complete FROM documents""",
    "promotion_gate": "SELECT * EXCLUDE (run), run AS validation_run_id FROM i_gate",
    "staging_promotion": """SELECT a.transaction_id, g.ingestion_batch_id, g.run AS validation_run_id, a.amount_gbp
FROM i_accepted a JOIN i_gate g ON g.ingestion_batch_id = CAST(substr(a.subscription_id, 5) AS BIGINT) AND g.promoted""",
    "orphan_partitions": """SELECT ingestion_batch_id, count(*) AS row_count FROM i_batches
WHERE ingestion_batch_id >= (SELECT max(ingestion_batch_id) - 1 FROM i_batches) GROUP BY 1""",
    "canonical_csv": "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(installation_id AS VARCHAR) AS installation_id, anonymous_id, "
    + ", ".join(f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%SZ'), '') AS {c}" for c in ("signed_up_at", "onboarding_started_at", "onboarding_completed_at"))
    + ", CASE WHEN onboarding_completed_at IS NOT NULL THEN 'true' ELSE 'false' END AS onboarded FROM users",
    "result_manifest": " UNION ALL ".join(
        f"""SELECT '{n}' AS dataset, '{_MANIFEST_COLUMNS[n]}' AS columns, count(*) AS row_count, '{{"dataset":"{n}","row_count":' || CAST(count(*) AS VARCHAR) || '}}' AS manifest_json FROM ({q})"""
        for n, q in _MANIFEST.items()),
}
