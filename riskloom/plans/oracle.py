"""Building blocks of the ANSI SQL that each query is compared with."""

from __future__ import annotations

from riskloom.operators.trailing import ENTITY_ROLES, feature_names

WINDOWS = (1, 7, 30)


def bucket(value: str, seed: str, pool: str, prefix: str) -> str:
    digest = f"sha256(({seed}) || ':{prefix}:' || ({value}))"
    number = f"(('0x' || substr({digest}, 1, 12))::BIGINT % ({pool}))"
    return f"('{prefix}_' || lpad({number}::VARCHAR, 3, '0'))"


def money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(18,4))"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0 AS {name}"


VIEWS = {
    "accounts": """
  SELECT CAST(c_custkey AS VARCHAR) AS account_id,
         CASE WHEN c_nationkey = 0 THEN 'party_' || c_custkey ELSE 'P_' || (c_custkey // 2) END AS party_id,
         'bank_' || c_nationkey AS bank_id, r_name AS country_code, c_mktsegment AS business_type,
         c_acctbal AS initial_balance, c_nationkey::BIGINT AS start_step,
         (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey * 10 END)::BIGINT AS end_step,
         c_acctbal < -500 AS source_suspicious_flag, (c_nationkey % 5)::BIGINT AS model_id,
         'converted_outputs' AS layout_name, 'source_native' AS source_type,
         c_acctbal < 0 AS is_alerted, (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS alert_count
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "alerts": """
  SELECT 'AL' || account_id AS alert_id, business_type AS alert_type, account_id, party_id,
         start_step::VARCHAR AS event_value, initial_balance < -500 AS is_sar, layout_name
  FROM accounts WHERE is_alerted""",
    "parties": """
  SELECT party_id, arg_min(country_code, account_id::BIGINT) AS country_code, 'converted_outputs' AS layout_name,
         'individual' AS party_type, 'source_native_or_sample_fallback' AS source_type,
         count(DISTINCT account_id) AS account_count, bool_or(is_alerted) AS is_alerted,
         count(*) FILTER (WHERE is_alerted) AS alert_count
  FROM accounts GROUP BY party_id""",
    "banks": """
  SELECT DISTINCT bank_id, country_code AS country_hint, 'source_native' AS source_type FROM accounts""",
    "sized": "SELECT *, (SELECT count(*) FROM customer) AS n FROM orders",
    "moves": """
  SELECT o_orderkey::VARCHAR AS transaction_id, o_custkey::VARCHAR AS source_account_id,
         CASE WHEN o_orderstatus <> 'P'
              THEN (((o_orderkey % n) * (o_orderkey % n) + o_custkey) % n)::VARCHAR END AS destination_account_id,
         o_orderpriority AS transaction_type, o_totalprice AS amount,
         (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 7 + 1)::BIGINT AS event_step,
         strftime(o_orderdate, '%Y-%m-%d') AS event_timestamp, o_orderstatus = 'P' AS is_cash,
         'converted_outputs' AS layout_name, o_orderkey AS tid,
         o_orderpriority = '1-URGENT' AND o_totalprice >= 450000 AS direct
  FROM sized""",
    "labelled": """
  SELECT m.*, s.party_id AS source_party_id, d.party_id AS destination_party_id,
         coalesce(s.is_alerted, false) OR coalesce(d.is_alerted, false) AS adjacent,
         direct OR coalesce(s.is_alerted, false) OR coalesce(d.is_alerted, false) AS is_alert_related
  FROM moves m LEFT JOIN accounts s ON m.source_account_id = s.account_id
  LEFT JOIN accounts d ON m.destination_account_id = d.account_id""",
    "transactions": """
  SELECT transaction_id, source_account_id, destination_account_id, transaction_type, amount, event_step,
         event_timestamp, is_cash, layout_name, source_party_id, destination_party_id, is_alert_related,
         CASE WHEN direct THEN 'direct_alert_transaction' WHEN adjacent THEN 'alert_adjacent_account'
              ELSE 'none' END AS label_source, 'source_native' AS source_type, tid
  FROM labelled""",
    "account_device_links": f"""
  SELECT account_id, {bucket('account_id', "CASE WHEN is_alerted THEN '117' ELSE '17' END",
                             "CASE WHEN is_alerted THEN 4 ELSE 16 END", 'device')} AS device_id FROM accounts""",
    "account_ip_links": f"""
  SELECT account_id, country_code, {bucket('account_id', "CASE WHEN is_alerted THEN '217' ELSE '17' END",
                                           "CASE WHEN is_alerted THEN 8 ELSE 64 END", 'ip')} AS ip_id FROM accounts""",
    "transaction_merchant_links": f"""
  SELECT transaction_id, {bucket("coalesce(destination_account_id, source_account_id) || ':' || transaction_type",
                                 "'317'", '24', 'merchant')} AS merchant_id FROM transactions""",
    "devices": """
  SELECT device_id, count(DISTINCT account_id) AS shared_account_count, 'derived' AS source_type,
         regexp_extract(device_id, '(\\d+)$', 1) AS device_family FROM account_device_links GROUP BY device_id""",
    "ip_addresses": """
  SELECT ip_id, count(DISTINCT account_id) AS shared_account_count, 'US' AS country_hint, 'derived' AS source_type
  FROM account_ip_links GROUP BY ip_id""",
    "merchants": """
  SELECT merchant_id, count(DISTINCT transaction_id) AS transaction_count, 'derived' AS source_type,
         regexp_extract(merchant_id, '(\\d+)$', 1) AS merchant_segment
  FROM transaction_merchant_links GROUP BY merchant_id""",
    "nodes": """
  SELECT c_custkey AS node_id, (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS is_fraud,
         c_acctbal AS initial_balance, (CASE WHEN c_acctbal < 0 THEN c_nationkey ELSE -1 END)::BIGINT AS fraud_step
  FROM customer""",
    "transfers": """
  SELECT source_account_id::BIGINT AS source_node_id, destination_account_id::BIGINT AS target_node_id, amount,
         event_step AS event_time, tid AS transaction_id, 0.0::DOUBLE AS transaction_type_code
  FROM moves WHERE NOT is_cash""",
    "edges": """
  SELECT source_node_id AS src, target_node_id AS dst, count(*) AS edge_count,
         sum(CAST(amount AS DECIMAL(18,4)))::DOUBLE AS total_amount, min(event_time) AS first_time,
         max(event_time) AS last_time FROM transfers GROUP BY ALL""",
    "arcs": """
  SELECT DISTINCT src AS u, dst AS v FROM edges WHERE src <> dst
  UNION SELECT dst, src FROM edges WHERE src <> dst""",
    "archive_links": f"""
  SELECT transaction_id, source_node_id, target_node_id, amount, event_time,
         {bucket('target_node_id::VARCHAR', "'317'", '24', 'merchant')} AS merchant_id,
         regexp_extract({bucket('target_node_id::VARCHAR', "'317'", '24', 'merchant')}, '(\\d+)$', 1)::INTEGER
           AS merchant_segment FROM transfers""",
    "event_series": """
  SELECT event_id AS transaction_id, user_id::VARCHAR AS source_account_id, day(ts)::BIGINT AS event_step,
         value AS amount, event_type AS transaction_type, event_id AS tid FROM events""",
    "scored": """
  SELECT c_custkey AS account_id, (CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS label,
         round((c_nationkey * 41 % 100) / 100.0, 2)::DOUBLE AS score FROM customer""",
}


def history_columns(entity: str, prefix: str, windows=WINDOWS) -> list[str]:
    """SQL expressions of the nine trailing features of one entity role, in ``feature_names`` order."""
    order = "event_step, tid"

    def within(aggregate: str, w: int) -> str:
        upto = f"{aggregate} OVER (PARTITION BY {entity} ORDER BY event_step RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"
        rest = (
            f"{aggregate} OVER (PARTITION BY {entity}, event_step ORDER BY tid "
            "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        )
        return f"(CASE WHEN {entity} IS NULL THEN 0 ELSE {upto} - {rest} END)::DOUBLE"

    gap = f"coalesce(event_step - lag(event_step) OVER (PARTITION BY {entity} ORDER BY {order}), -1)"
    result = [f"(CASE WHEN {entity} IS NULL THEN 0 ELSE {gap} END)::DOUBLE AS {prefix}_previous_gap"]
    for w in windows:
        result.append(f"{within('count(*)', w)} AS {prefix}_count_prev_{w}")
        result.append(f"{within('sum(CAST(amount AS DECIMAL(18,4)))', w)} AS {prefix}_amount_prev_{w}")
    return result


def ratios(prefix: str, windows=WINDOWS) -> list[str]:
    last = windows[-1]
    return [
        f"CASE WHEN {prefix}_{part}_prev_{last} = 0 THEN 0.0 ELSE {prefix}_{part}_prev_1 / {prefix}_{part}_prev_{last} "
        f"END AS {prefix}_{name}_ratio_1_to_{last}"
        for name, part in (("velocity", "count"), ("amount", "amount"))
    ]


def _history_views() -> dict[str, str]:
    base = [c for e, p in ENTITY_ROLES for c in history_columns(e, p)]
    more = [c for _, p in ENTITY_ROLES for c in ratios(p)]
    return {
        "history_base": f"SELECT *, {', '.join(base)} FROM transactions",
        "history": f"SELECT *, {', '.join(more)} FROM history_base",
        "event_base": f"SELECT *, {', '.join(history_columns('source_account_id', 'user'))} FROM event_series",
        "event_history": f"SELECT *, {', '.join(ratios('user'))} FROM event_base",
    }


VIEWS.update(_history_views())
HISTORY_FEATURES = [n for _, p in ENTITY_ROLES for n in feature_names(p, WINDOWS)]


def sql(body: str, **extra: str) -> str:
    """``body`` with every view it reaches in front of it, then the ``extra`` ones."""
    import re

    known = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in known:
            if name in words and name not in needed:
                visit_one(name)

    def visit_one(name: str) -> None:
        words = set(re.findall(r"\w+", known[name])) - {name}
        for other in known:
            if other in words and other not in needed:
                visit_one(other)
        needed.append(name)

    visit(body)
    views = ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    return (f"WITH {views}\n" if views else "") + body
