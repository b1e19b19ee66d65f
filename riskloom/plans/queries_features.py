"""Aggregates, trailing windows, feature tables, quality checks, profiles and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.columns import coerced_cells
from riskloom.functions.ordered import running_totals
from riskloom.operators import drift, features, flows, metrics, quality, trailing
from riskloom.operators.trailing import feature_names
from riskloom.plans.data import WINDOWS
from riskloom.plans.oracle import HISTORY_FEATURES, money, r
from riskloom.plans.queries_tables import CONFUSION, scored_accounts
from riskloom.plans.registry import query

# ---- aggregations -----------------------------------------------------------------------------


def profile_sql(key: str, other: str, side: str, distinct: str, view: str = "transactions") -> str:
    return f"""SELECT {key}, count(*) AS {side}_transaction_count,
 {r("sum(" + money("amount") + ")", side + "_amount_total")}, count(DISTINCT {other}) AS {distinct}
 FROM {view} WHERE {key} IS NOT NULL GROUP BY {key}"""


@query("A1_outgoing_profile", profile_sql(
    "source_account_id", "destination_account_id", "outgoing", "unique_destinations"))
def _(data):
    return features.outgoing_profile(data.transactions, "source_account_id")


@query("A2_incoming_profile", profile_sql(
    "destination_account_id", "source_account_id", "incoming", "unique_sources"))
def _(data):
    return features.incoming_profile(data.transactions, "destination_account_id")


OUT_PARTY = profile_sql("source_party_id", "destination_account_id", "outgoing", "unique_destination_accounts")
IN_PARTY = profile_sql("destination_party_id", "source_account_id", "incoming", "unique_source_accounts")


@query("A3_party_profiles", "SELECT p.party_id, o.* EXCLUDE (source_party_id), i.* EXCLUDE (destination_party_id) "
       "FROM parties p LEFT JOIN out_party o ON p.party_id = o.source_party_id LEFT JOIN in_party i "
       "ON p.party_id = i.destination_party_id", out_party=OUT_PARTY, in_party=IN_PARTY)
def _(data):
    t = data.transactions
    out = features.outgoing_profile(t, "source_party_id", "unique_destination_accounts")
    into = features.incoming_profile(t, "destination_party_id", "unique_source_accounts")
    return (
        data.tables["parties"].select("party_id")
        .join(out.withColumnRenamed("source_party_id", "party_id"), "party_id", "left")
        .join(into.withColumnRenamed("destination_party_id", "party_id"), "party_id", "left")
    )


PARTY_LINKS = """
SELECT a.party_id, count(DISTINCT d.device_id) AS device_count, count(DISTINCT i.ip_id) AS ip_count FROM accounts a
JOIN account_device_links d USING (account_id) JOIN account_ip_links i USING (account_id) GROUP BY a.party_id"""


@query("A4_party_links", PARTY_LINKS)
def _(data):
    t = data.tables
    devices = features.links_per_party(t["account_device_links"], t["accounts"], "device_id", "device_count")
    addresses = features.links_per_party(t["account_ip_links"], t["accounts"], "ip_id", "ip_count")
    return devices.join(addresses, "party_id")


SHARED = """
SELECT account_id, d.n AS shared_device_count, i.n AS shared_ip_count FROM account_device_links
JOIN account_ip_links USING (account_id)
JOIN (SELECT device_id, count(DISTINCT account_id) AS n FROM account_device_links GROUP BY 1) d USING (device_id)
JOIN (SELECT ip_id, count(DISTINCT account_id) AS n FROM account_ip_links GROUP BY 1) i USING (ip_id)"""


@query("A5_shared_infrastructure", SHARED)
def _(data):
    attributes = features.account_attributes(data.tables)
    return attributes.select("account_id", "shared_device_count", "shared_ip_count")


def flow_side(key: str, other: str, side: str) -> str:
    total = f"sum({money('amount')})::DOUBLE"
    return f"""SELECT {key} AS node_id, count(*) AS {side}_transaction_count, {total} AS {side}_amount_total,
 {total} / count(*) AS {side}_amount_mean, count(DISTINCT {other}) AS {side}_counterparty_count,
 min(event_time) AS {side}_first_time, max(event_time) AS {side}_last_time FROM transfers GROUP BY 1"""


def filled(side: str) -> str:
    whole = ("transaction_count", "counterparty_count", "first_time", "last_time")
    return ", ".join(
        [f"coalesce({side}_{n}, 0) AS {side}_{n}" for n in whole]
        + [r(f"coalesce({side}_{n}, 0)", f"{side}_{n}") for n in ("amount_total", "amount_mean")]
    )


FLOWS = f"""SELECT node_id, is_fraud, initial_balance, fraud_step, {filled('outgoing')}, {filled('incoming')},
 greatest(coalesce(outgoing_last_time - outgoing_first_time, 0), 0) AS outgoing_time_span,
 greatest(coalesce(incoming_last_time - incoming_first_time, 0), 0) AS incoming_time_span,
 coalesce(outgoing_transaction_count, 0) + coalesce(incoming_transaction_count, 0) AS total_transaction_count,
 {r("coalesce(outgoing_amount_total, 0) + coalesce(incoming_amount_total, 0)", "total_amount")},
 {r("coalesce(outgoing_amount_total, 0) - coalesce(incoming_amount_total, 0)", "net_outgoing_amount")}
FROM nodes LEFT JOIN out_flow USING (node_id) LEFT JOIN in_flow USING (node_id)"""
FLOW_VIEWS = {
    "out_flow": flow_side("source_node_id", "target_node_id", "outgoing"),
    "in_flow": flow_side("target_node_id", "source_node_id", "incoming"),
}


def to_four(df, names):
    return df.withColumns({n: F.round(n, 4) for n in names})



@query("A6_account_flows", FLOWS, **FLOW_VIEWS)
def _(data):
    return flows.account_flows(data.nodes, flows.pair_totals(data.transfers))


def velocity_sql(key: str, other: str, side: str) -> str:
    parts = []
    for w in WINDOWS:
        inside = f"FILTER (WHERE event_time >= (SELECT max(event_time) FROM transfers) - {w} + 1)"
        parts += [
            f"count(*) {inside} / {w}.0 AS {side}_tx_velocity_{w}d",
            f"coalesce(sum({money('amount')}) {inside}, 0)::DOUBLE / {w}.0 AS {side}_amount_velocity_{w}d",
            f"count(DISTINCT {other}) {inside} / {w}.0 AS {side}_counterparty_velocity_{w}d",
        ]
    return f"SELECT {key} AS node_id, {', '.join(parts)} FROM transfers GROUP BY 1"


@query("A7_account_velocities", "SELECT node_id, " + ", ".join(
    r(f"coalesce({n}, 0)", n) for n in flows.velocity_names(WINDOWS)
) + " FROM nodes LEFT JOIN out_speed USING (node_id) LEFT JOIN in_speed USING (node_id)",
    out_speed=velocity_sql("source_node_id", "target_node_id", "outgoing"),
    in_speed=velocity_sql("target_node_id", "source_node_id", "incoming"))
def _(data):
    pairs = flows.pair_totals(data.transfers, WINDOWS)
    return flows.account_flows(data.nodes, pairs, WINDOWS).select("node_id", *flows.velocity_names(WINDOWS))


@query("A8_merchant_rollup", f"""
SELECT merchant_id, count(*) AS transaction_count, {r("sum(" + money("amount") + ")", "total_amount")},
 {r("sum(" + money("amount") + ")::DOUBLE / count(*)", "average_amount")},
 count(DISTINCT source_node_id) AS unique_buyer_count, count(DISTINCT target_node_id) AS unique_anchor_account_count,
 min(event_time) AS first_event_time, max(event_time) AS last_event_time, max(merchant_segment) AS merchant_segment,
 max(event_time) - min(event_time) AS active_time_span FROM archive_links GROUP BY merchant_id""")
def _(data):
    return flows.merchant_features(flows.pair_totals(data.transfers))


def _merchant_speed() -> str:
    parts = []
    for w in WINDOWS:
        inside = f"FILTER (WHERE event_time >= (SELECT max(event_time) FROM transfers) - {w} + 1)"
        parts += [
            r(f"count(*) {inside} / {w}.0", f"merchant_tx_velocity_{w}d"),
            r(f"coalesce(sum({money('amount')}) {inside}, 0)::DOUBLE / {w}.0", f"merchant_amount_velocity_{w}d", 4),
            r(f"count(DISTINCT source_node_id) {inside} / {w}.0", f"merchant_buyer_velocity_{w}d"),
        ]
    return f"SELECT merchant_id, {', '.join(parts)} FROM archive_links GROUP BY merchant_id"


@query("A9_merchant_velocities", _merchant_speed())
def _(data):
    rows = flows.merchant_features(flows.pair_totals(data.transfers, WINDOWS), WINDOWS)
    speeds = [c for c in rows.columns if "velocity" in c]
    return to_four(rows.select("merchant_id", *speeds), [c for c in speeds if "amount" in c])


@query("A10_account_merchant", f"""
SELECT n.node_id, count(transaction_id) AS merchant_transaction_count,
 {r("coalesce(sum(" + money("amount") + "), 0)", "merchant_total_amount")},
 count(DISTINCT merchant_id) AS unique_merchant_count FROM nodes n LEFT JOIN archive_links l
 ON n.node_id = l.source_node_id GROUP BY n.node_id""")
def _(data):
    return flows.merchant_interactions(data.nodes.select("node_id"), data.pairs)


ACTIVITY = f"""
SELECT event_step, count(*) AS transaction_count, count(*) FILTER (WHERE is_alert_related) AS alert_related_count,
 count(*) FILTER (WHERE is_cash) AS cash_count, {r("sum(" + money("amount") + ")", "amount_total")},
 {r("count(*) FILTER (WHERE is_alert_related)::DOUBLE / count(*)", "alert_related_rate")},
 {r("count(*) FILTER (WHERE is_cash)::DOUBLE / count(*)", "cash_rate")} FROM transactions GROUP BY event_step"""


@query("A11_activity_by_step", ACTIVITY)
def _(data):
    return drift.activity_by_step(data.transactions)


def _scorecard() -> str:
    parts = []
    for w in WINDOWS:
        inside = f"FILTER (WHERE event_step >= (SELECT max(event_step) FROM transactions) - {w} + 1"
        parts += [
            f"count(*) {inside}) AS transactions_recent_{w}",
            r(f"sum({money('amount')}) {inside})", f"amount_recent_{w}"),
            f"count(*) {inside} AND is_alert_related) AS alert_related_recent_{w}",
        ]
    return ("SELECT min(event_step) AS min_step, max(event_step) AS max_step, count(*) AS transaction_count, "
            + ", ".join(parts) + " FROM transactions")


@query("A12_recent_scorecard", _scorecard())
def _(data):
    return drift.recent_scorecard(data.transactions, WINDOWS)


@query("A13_value_counts", "SELECT transaction_type AS value, count(*) AS n FROM transactions GROUP BY 1")
def _(data):
    return quality.value_counts(data.transactions, "transaction_type")


def rate(flag: str, view: str, name: str) -> str:
    return f"SELECT '{name}' AS metric, {r(f'count(*) FILTER (WHERE {flag})::DOUBLE / count(*)', 'value')} FROM {view}"


RATES = " UNION ALL ".join([
    rate("is_alerted", "accounts", "account_alert_rate"), rate("is_alert_related", "transactions", "transaction_alert_rate"),
    rate("is_cash", "transactions", "cash_transaction_rate")])


@query("A14_safe_rates", RATES)
def _(data):
    return quality.union_all([
        quality.flag_rate(data.tables["accounts"], "is_alerted", "account_alert_rate"),
        quality.flag_rate(data.transactions, "is_alert_related", "transaction_alert_rate"),
        quality.flag_rate(data.transactions, "is_cash", "cash_transaction_rate"),
    ])


def describe_sql(column: str, view: str, metric: str) -> str:
    parts = {
        "count": f"count({column})", "mean": f"avg({column})", "std": f"stddev_samp({column})",
        "min": f"min({column})", "max": f"max({column})", "p25": f"quantile_cont({column}, 0.25)",
        "p50": f"quantile_cont({column}, 0.5)", "p75": f"quantile_cont({column}, 0.75)",
    }
    return " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, '{n}' AS statistic, {r(e, 'value', 4)} FROM {view}" for n, e in parts.items()
    )


@query("A15_describe", describe_sql("amount", "transactions", "amount") + " UNION ALL "
       + describe_sql("l_extendedprice", "lineitem", "price"))
def _(data):
    parts = [
        quality.describe_number(data.transactions, "amount", "amount"),
        quality.describe_number(data.table("lineitem"), "l_extendedprice", "price"),
    ]
    return to_four(quality.union_all(parts), ["value"])


@query("A16_edge_aggregation", "SELECT * FROM edges")
def _(data):
    from riskloom.operators.graph import weighted_edges

    return weighted_edges(data.transfers, "source_node_id", "target_node_id", "amount", "event_time")


@query("A17_entity_rollups", "SELECT device_id AS entity_id, shared_account_count AS n FROM devices UNION ALL SELECT "
       "ip_id, shared_account_count FROM ip_addresses UNION ALL SELECT merchant_id, transaction_count FROM merchants")
def _(data):
    keys = (("devices", "device_id", "shared_account_count"), ("ip_addresses", "ip_id", "shared_account_count"),
            ("merchants", "merchant_id", "transaction_count"))
    return quality.union_all([data.fresh[t].select(F.col(k).alias("entity_id"), F.col(n).alias("n")) for t, k, n in keys])


@query("A18_alert_counts", "SELECT party_id, account_count, alert_count, is_alerted FROM parties")
def _(data):
    return data.fresh["parties"].select("party_id", "account_count", "alert_count", "is_alerted")


@query("A19_confusion_counts", f"SELECT threshold, tp, fp, fn, tn, "
       f"{r('CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END', 'precision')}, "
       f"{r('CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END', 'recall')}, "
       f"{r('CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END', 'f1')} FROM confusion",
       confusion=CONFUSION)
def _(data):
    return metrics.threshold_metrics(scored_accounts(data))


# ---- trailing windows -------------------------------------------------------------------------

USER_FEATURES = feature_names("user", WINDOWS)


def user_history(data):
    return trailing.add_trailing_history(
        data.events, "source_account_id", "user", windows=WINDOWS, ids=("transaction_id",)
    )


@query("W1_trailing_windows", "SELECT transaction_id, " + ", ".join(r(n, n) for n in USER_FEATURES[1:7])
       + " FROM event_history")
def _(data):
    return user_history(data).select("transaction_id", *USER_FEATURES[1:7])


@query("W2_previous_gap", "SELECT transaction_id, user_previous_gap FROM event_history")
def _(data):
    return user_history(data).select("transaction_id", "user_previous_gap")


@query("W3_window_ratios", "SELECT transaction_id, " + ", ".join(r(n, n) for n in USER_FEATURES[7:])
       + " FROM event_history")
def _(data):
    return user_history(data).select("transaction_id", *USER_FEATURES[7:])


@query("W4_three_entity_history", "SELECT transaction_id, is_cash, " + ", ".join(r(n, n) for n in HISTORY_FEATURES)
       + " FROM history")
def _(data):
    rows = trailing.transaction_history(data.transactions, windows=WINDOWS)
    return rows.select("transaction_id", "is_cash", *HISTORY_FEATURES)


def party_side(key: str, name: str) -> str:
    parts = []
    for w in WINDOWS:
        inside = f"FILTER (WHERE event_step >= (SELECT max(event_step) FROM transactions) - {w} + 1)"
        parts += [
            f"count(*) {inside} AS {name}_count_recent_{w}",
            f"coalesce(sum({money('amount')}) {inside}, 0)::DOUBLE AS {name}_amount_recent_{w}",
        ]
    return f"""SELECT {key} AS party_id, min(event_step) AS {name}_first, max(event_step) AS {name}_last,
 coalesce(avg(gap), 0) AS average_{name}_gap, coalesce(max(gap), 0) AS max_{name}_gap, {', '.join(parts)}
 FROM (SELECT *, event_step - lag(event_step) OVER (PARTITION BY {key} ORDER BY event_step, tid) AS gap
 FROM transactions WHERE {key} IS NOT NULL) g GROUP BY 1"""


PARTY_VIEWS = {
    "out_party_time": party_side("source_party_id", "outgoing"),
    "in_party_time": party_side("destination_party_id", "incoming"),
}
GAPS = ["average_outgoing_gap", "max_outgoing_gap", "average_incoming_gap", "max_incoming_gap"]
PARTY_TIME = """FROM parties p LEFT JOIN out_party_time o ON p.party_id = o.party_id
 LEFT JOIN in_party_time i ON p.party_id = i.party_id"""
PARTY_GAPS = ("coalesce(outgoing_first, 0) AS first_activity_step, coalesce(outgoing_last, 0) AS last_activity_step, "
              "coalesce(outgoing_last - outgoing_first, 0) AS activity_span_steps, "
              + ", ".join(r(f"coalesce({g}, 0)", g) for g in GAPS))
PARTY_RECENT = ", ".join(
    [f"coalesce({s}_count_recent_{w}, 0)::BIGINT AS {s}_count_recent_{w}" for s in ("outgoing", "incoming") for w in WINDOWS]
    + [r(f"coalesce({s}_amount_recent_{w}, 0)", f"{s}_amount_recent_{w}") for s in ("outgoing", "incoming") for w in WINDOWS]
    + [r("coalesce(outgoing_count_recent_1::DOUBLE / nullif(outgoing_count_recent_30, 0), 0)",
         "outgoing_velocity_ratio_1_to_30")])


@query("W5_party_gaps", f"SELECT p.party_id, {PARTY_GAPS} {PARTY_TIME}", **PARTY_VIEWS)
def _(data):
    rows = trailing.party_activity(data.transactions, data.tables["parties"], windows=WINDOWS)
    return rows.select("party_id", "first_activity_step", "last_activity_step", "activity_span_steps", *GAPS)


@query("W6_party_recency", f"SELECT p.party_id, {PARTY_RECENT} {PARTY_TIME}", **PARTY_VIEWS)
def _(data):
    rows = trailing.party_activity(data.transactions, data.tables["parties"], windows=WINDOWS)
    return rows.drop("first_activity_step", "last_activity_step", "activity_span_steps", *GAPS)


@query("W7_empirical_cdf", """
SELECT l_returnflag, price, sum(n) OVER (PARTITION BY l_returnflag ORDER BY price)::BIGINT AS n_upto FROM
(SELECT l_returnflag, l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY ALL)""")
def _(data):
    counts = data.table("lineitem").groupBy("l_returnflag", F.col("l_extendedprice").alias("price")).agg(
        F.count("*").alias("n")
    )
    return running_totals(counts, ["l_returnflag"], "price", ["n"]).drop("n")


CURVE = """SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS tp_upto, sum(fp) OVER (ORDER BY score DESC) AS fp_upto
 FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp FROM scored GROUP BY 1)"""


@query("W8_ranking_curve", "SELECT score, tp_upto::BIGINT AS tp_upto, fp_upto::BIGINT AS fp_upto FROM curve", curve=CURVE)
def _(data):
    curve = metrics.ranking_curve(scored_accounts(data))
    return curve.select((-F.col("rank_key")).alias("score"), "tp_upto", "fp_upto")


# ---- feature tables ---------------------------------------------------------------------------

TRANSACTION_SQL = f"""SELECT h.transaction_id, h.source_account_id, h.destination_account_id, h.transaction_type, h.amount,
 h.event_step, h.is_cash, o.outgoing_transaction_count, o.outgoing_amount_total, o.unique_destinations,
 coalesce(i.incoming_transaction_count, 0) AS incoming_transaction_count,
 coalesce(i.incoming_amount_total, 0) AS incoming_amount_total, coalesce(i.unique_sources, 0) AS unique_sources,
 s.initial_balance AS source_initial_balance, s.is_alerted AS source_is_alerted,
 ss.shared_device_count AS source_shared_device_count, ss.shared_ip_count AS source_shared_ip_count,
 coalesce(d.initial_balance, 0) AS destination_initial_balance, coalesce(d.is_alerted, false) AS destination_is_alerted,
 coalesce(ds.shared_device_count, 0) AS destination_shared_device_count,
 coalesce(ds.shared_ip_count, 0) AS destination_shared_ip_count,
 {', '.join(r('h.' + n, n) for n in HISTORY_FEATURES)}, h.is_alert_related::INTEGER AS label, h.label_source
FROM history h JOIN out_account o USING (source_account_id) LEFT JOIN in_account i
 ON h.destination_account_id = i.destination_account_id
JOIN accounts s ON s.account_id = h.source_account_id JOIN shared ss ON ss.account_id = h.source_account_id
LEFT JOIN accounts d ON d.account_id = h.destination_account_id LEFT JOIN shared ds ON ds.account_id = d.account_id"""
ACCOUNT_VIEWS = {
    "shared": SHARED,
    "out_account": profile_sql("source_account_id", "destination_account_id", "outgoing", "unique_destinations"),
    "in_account": profile_sql("destination_account_id", "source_account_id", "incoming", "unique_sources"),
}


@query("C14_transaction_features", TRANSACTION_SQL, **ACCOUNT_VIEWS)
def _(data):
    return features.transaction_features(data.tables, windows=WINDOWS)


PARTY_SQL = f"""SELECT p.party_id, p.party_type, p.country_code, p.account_count, p.alert_count,
 coalesce(op.outgoing_transaction_count, 0) AS outgoing_transaction_count,
 coalesce(op.outgoing_amount_total, 0) AS outgoing_amount_total,
 coalesce(op.unique_destination_accounts, 0) AS unique_destination_accounts,
 coalesce(ip.incoming_transaction_count, 0) AS incoming_transaction_count,
 coalesce(ip.incoming_amount_total, 0) AS incoming_amount_total,
 coalesce(ip.unique_source_accounts, 0) AS unique_source_accounts, l.device_count, l.ip_count, {PARTY_GAPS}, {PARTY_RECENT},
 p.is_alerted::INTEGER AS label {PARTY_TIME}
 LEFT JOIN out_party op ON p.party_id = op.source_party_id LEFT JOIN in_party ip ON p.party_id = ip.destination_party_id
 LEFT JOIN party_links l ON p.party_id = l.party_id"""
PARTY_ALL = {**PARTY_VIEWS, "out_party": OUT_PARTY, "in_party": IN_PARTY, "party_links": PARTY_LINKS}


@query("C15_party_features", PARTY_SQL, **PARTY_ALL)
def _(data):
    return features.party_features(data.tables, windows=WINDOWS)


@query("C16_feature_sets", "SELECT 'transaction' AS feature_set, count(*) AS row_count, sum(is_alert_related::INTEGER)::BIGINT "
       "AS labelled FROM transactions UNION ALL SELECT 'party', count(*), sum(is_alerted::INTEGER)::BIGINT FROM parties")
def _(data):
    sets = {"transaction": data.transaction_features, "party": data.party_features}
    return quality.union_all([
        df.agg(F.count("*").alias("row_count"), F.sum("label").alias("labelled")).select(
            F.lit(n).alias("feature_set"), "row_count", "labelled") for n, df in sets.items()
    ])


# ---- quality and profiles ---------------------------------------------------------------------

TABLES = ("accounts", "parties", "transactions", "alerts", "banks", "devices", "ip_addresses", "merchants",
          "account_device_links", "account_ip_links", "transaction_merchant_links")
COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
NULLS = """SELECT 'transactions' AS table_name, column_name, null_count FROM (SELECT
 count(*) FILTER (WHERE destination_account_id IS NULL) AS destination_account_id,
 count(*) FILTER (WHERE destination_party_id IS NULL) AS destination_party_id FROM transactions)
 UNPIVOT (null_count FOR column_name IN (destination_account_id, destination_party_id))"""
DUPLICATES = " UNION ALL ".join(
    f"SELECT '{name}' AS key_name, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {t}))"
    " AS duplicate_rows" for name, (t, k) in quality.UNIQUE_KEYS.items())
FOREIGN = " UNION ALL ".join(
    f"SELECT '{s}.{c} -> {t}.{tc}' AS relation, count(*) FILTER (WHERE m) = 0 AS passed, count(*) FILTER (WHERE m) AS "
    f"missing_references, count(*) AS checked_rows FROM (SELECT NOT EXISTS (SELECT 1 FROM {t} y WHERE y.{tc} = x.{c}) AS m "
    f"FROM {s} x {'WHERE x.' + c + ' IS NOT NULL' if absent else ''})"
    for s, c, t, tc, absent in quality.FOREIGN_KEYS)


@query("V1_row_counts", COUNTS)
def _(data):
    return quality.row_counts({t: data.tables[t] for t in TABLES})


@query("V2_null_counts", NULLS)
def _(data):
    return quality.null_counts(data.tables)


@query("V3_duplicate_keys", DUPLICATES + """ UNION ALL SELECT 'lineitem.order_line', count(*) - (SELECT count(*) FROM
 (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem""")
def _(data):
    lines = quality.duplicate_count(data.table("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem.order_line")
    return quality.duplicate_counts(data.tables).unionByName(lines)


@query("V4_foreign_keys", FOREIGN)
def _(data):
    return quality.foreign_key_checks(data.tables)


@query("V5_required_columns", "SELECT table_name, required::BIGINT AS required, filled FROM (SELECT 'accounts' AS table_name, "
       "5 AS required, count(account_id) + count(party_id) + count(bank_id) + count(initial_balance) + count(is_alerted) AS "
       "filled FROM accounts UNION ALL SELECT 'parties', 3, count(party_id) + count(party_type) + count(is_alerted) FROM "
       "parties UNION ALL SELECT 'transactions', 4, count(transaction_id) + count(source_account_id) + count(amount) + "
       "count(is_alert_related) FROM transactions UNION ALL SELECT 'alerts', 3, count(alert_id) + count(account_id) + "
       "count(party_id) FROM alerts)")
def _(data):
    present = {n: [c for c in cs if c in data.tables[n].columns] for n, cs in quality.REQUIRED_COLUMNS.items()}
    return quality.union_all([
        data.tables[n].agg(sum((F.count(c) for c in cs), F.lit(0)).alias("filled")).select(
            F.lit(n).alias("table_name"), F.lit(len(cs)).cast("bigint").alias("required"), "filled")
        for n, cs in present.items()
    ])


@query("V6_validation_verdict", "SELECT (SELECT count(*) FROM foreign_checks WHERE NOT passed) = 0 AND (SELECT "
       "coalesce(max(duplicate_rows), 0) FROM duplicate_checks) = 0 AS all_checks_passed",
       foreign_checks=FOREIGN, duplicate_checks=DUPLICATES)
def _(data):
    return quality.verdict(quality.validation_report(data.tables))


PROFILE = " UNION ALL ".join([
    f"SELECT 'table_row_counts' AS section, table_name AS item, row_count::DOUBLE AS value FROM ({COUNTS})",
    f"SELECT 'rates', metric, value FROM ({RATES} UNION ALL {rate('is_alerted', 'parties', 'party_alert_rate')})",
    "SELECT 'transaction_type_distribution', transaction_type, count(*)::DOUBLE FROM transactions GROUP BY 2",
    "SELECT 'label_source_distribution', label_source, count(*)::DOUBLE FROM transactions GROUP BY 2",
    f"SELECT 'amount_summary', statistic, value FROM ({describe_sql('amount', 'transactions', 'amount')})",
    f"SELECT 'initial_balance_summary', statistic, value FROM ({describe_sql('initial_balance', 'accounts', 'b')})",
    *[f"SELECT * FROM (SELECT '{s}', {k}, {m}::DOUBLE FROM {t} ORDER BY {m} DESC, {k} LIMIT 10)" for s, t, m, k in (
        ("top_shared_devices", "devices", "shared_account_count", "device_id"),
        ("top_shared_ip_addresses", "ip_addresses", "shared_account_count", "ip_id"),
        ("top_merchants", "merchants", "transaction_count", "merchant_id"))],
])


@query("V7_profile_report", f"SELECT section, item, round(value, 4) + 0.0 AS value FROM ({PROFILE})")
def _(data):
    return to_four(quality.profile_report({t: data.tables[t] for t in TABLES}), ["value"])


@query("V8_coerced_cells", """
SELECT 'end' AS column_name, count(*) FILTER (WHERE business_type = 'BUILDING') AS coerced_cells FROM accounts UNION ALL
SELECT 'init_balance', 0 FROM accounts HAVING count(*) >= 0 UNION ALL SELECT 'suspicious', count(*) FILTER (WHERE NOT
(initial_balance > 9000)) FROM accounts""")
def _(data):
    return coerced_cells(data.raw["accounts"], ["end", "init_balance", "suspicious"])


# ---- drift ------------------------------------------------------------------------------------

BOUNDS = "SELECT min(event_step) AS lo, max(event_step) AS hi FROM transactions"


@query("D1_time_cohorts", """
SELECT lo AS min_step, hi AS max_step, greatest(lo, hi - 36) AS baseline_start, hi - 7 AS baseline_end, hi - 6 AS recent_start,
 hi AS recent_end, (SELECT count(*) FROM transactions WHERE event_step BETWEEN greatest(lo, hi - 36) AND hi - 7) AS
 baseline_rows, (SELECT count(*) FROM transactions WHERE event_step >= hi - 6) AS recent_rows FROM step_bounds""",
       step_bounds=BOUNDS)
def _(data):
    return drift.cohort_summary(data.transactions)


def drift_sql(source: str, names: list[str]) -> dict[str, str]:
    """KS statistic, means and deltas per feature over ``source`` (cohort + feature columns)."""
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
    return {
        "cohort_rows": source,
        "long_values": f"SELECT cohort, feature, value FROM (SELECT cohort, {doubles} FROM cohort_rows) UNPIVOT (value FOR "
        f"feature IN ({', '.join(names)}))",
        "value_cells": "SELECT feature, value, count(*) FILTER (WHERE cohort = 'baseline') AS b, count(*) FILTER (WHERE "
        "cohort = 'recent') AS c FROM long_values GROUP BY ALL",
        "cumulative": "SELECT feature, sum(b) OVER w AS b, sum(c) OVER w AS c, sum(b) OVER (PARTITION BY feature) AS nb, "
        "sum(c) OVER (PARTITION BY feature) AS nc FROM value_cells WINDOW w AS (PARTITION BY feature ORDER BY value)",
        "ks_values": "SELECT feature, max(abs(b::DOUBLE / nb - c::DOUBLE / nc)) AS ks FROM cumulative WHERE nb > 0 AND nc > 0 "
        "GROUP BY 1",
        "mean_values": "SELECT feature, avg(value) FILTER (WHERE cohort = 'baseline') AS mb, avg(value) FILTER (WHERE cohort "
        "= 'recent') AS mr FROM long_values GROUP BY 1",
        "drift_rows": "SELECT feature, mb, mr, ks FROM ks_values JOIN mean_values USING (feature)",
    }


def drift_select(digits: int = 4) -> str:
    return ", ".join([
        "feature", r("mb", "baseline_mean", digits), r("mr", "recent_mean", digits), r("mr - mb", "mean_delta", digits),
        r("CASE WHEN mb = 0 THEN 0 ELSE (mr - mb) / abs(mb) END", "relative_change"), r("ks", "ks_statistic")])


HISTORY_COHORTS = f"""SELECT {', '.join(HISTORY_FEATURES)}, CASE WHEN event_step >= hi - 6 THEN 'recent' WHEN event_step
 BETWEEN greatest(lo, hi - 36) AND hi - 7 THEN 'baseline' END AS cohort FROM history, ({BOUNDS}) b WHERE event_step >= hi - 36"""
MEANS = ["baseline_mean", "recent_mean", "mean_delta"]


@query("D2_ks_statistic", f"SELECT feature, {r('ks', 'ks_statistic')} FROM ks_values", **drift_sql(
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 'recent' ELSE 'baseline' END "
    "AS cohort FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(data):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cohort = F.when(F.col("l_returnflag") == "R", "recent").otherwise("baseline").alias("cohort")
    rows = data.table("lineitem").select(*names, cohort)
    return drift.feature_drift(rows, names).select("feature", "ks_statistic")


KS_SIZES = """SELECT feature, max(abs(b::DOUBLE / nb - c::DOUBLE / nc)) AS ks, sqrt(max(nb)::DOUBLE * max(nc) / (max(nb) + max(nc)))
 AS root FROM cumulative WHERE nb > 0 AND nc > 0 GROUP BY 1"""
KS_TAILS = """SELECT feature, ks, CASE WHEN t = 0 THEN 1 WHEN t < 1 THEN 1 - sqrt(2 * pi()) / t * list_sum(list_transform(
 range(1, 30), lambda k: exp(0 - power((2 * k - 1) * pi(), 2) / (8 * t * t)))) ELSE 2 * list_sum(list_transform(range(1, 60),
 lambda k: power(-1, k - 1) * exp(0 - 2 * k * k * t * t))) END AS p FROM (SELECT *, (root + 0.12 + 0.11 / root) * ks AS t FROM ks_sizes)"""


@query("D3_ks_pvalue", f"SELECT feature, {r('ks', 'ks_statistic')}, {r('least(1, greatest(0, p))', 'ks_pvalue')} FROM ks_tails",
       **drift_sql(HISTORY_COHORTS, HISTORY_FEATURES), ks_sizes=KS_SIZES, ks_tails=KS_TAILS)
def _(data):
    return drift.with_pvalue(drift.temporal_drift(data.history)).select("feature", "ks_statistic", "ks_pvalue")


HALVES = """SELECT p_retailprice, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'recent' ELSE 'baseline' END AS cohort FROM part
WHERE p_partkey <= 2 * (SELECT count(*) // 2 FROM part)"""
# of two samples of one size n, the reflections of the paths that leave the band give the exact value
REFLECTED = """SELECT feature, ks, 2 * list_sum(list_transform(range(1, n // greatest(h, 1) + 1), lambda k: power(-1, k - 1)
 * exp(2 * lgamma(n + 1) - lgamma(n - k * h + 1) - lgamma(n + k * h + 1)))) AS p FROM (SELECT feature, ks, n,
 round(ks * n)::BIGINT AS h FROM ks_values JOIN (SELECT feature, max(nb)::BIGINT AS n FROM cumulative GROUP BY 1) USING (feature))"""


@query("D3_exact_pvalue", f"SELECT feature, {r('ks', 'ks_statistic')}, {r('least(1, p)', 'ks_pvalue')} FROM reflected",
       **drift_sql(HALVES, ["p_retailprice", "p_size"]), reflected=REFLECTED)
def _(data):
    part = data.table("part")
    rows = part.where(F.col("p_partkey") <= F.lit(2 * (part.count() // 2)))
    cohort = F.when(F.col("p_partkey") % 2 == 0, "recent").otherwise("baseline").alias("cohort")
    found = drift.feature_drift(rows.select("p_retailprice", "p_size", cohort), ["p_retailprice", "p_size"])
    return drift.with_pvalue(found, method="exact").select("feature", "ks_statistic", "ks_pvalue")


@query("D4_temporal_drift", f"SELECT {drift_select()}, ks >= 0.2 AS strong, "
       "row_number() OVER (ORDER BY ks DESC, abs(mr - mb) DESC, feature) <= 10 AS in_top FROM drift_rows",
       **drift_sql(HISTORY_COHORTS, HISTORY_FEATURES))
def _(data):
    report = drift.temporal_drift_report(data.history)
    return to_four(report, MEANS).drop("ks_pvalue", "baseline_rows", "recent_rows")


@query("D4_report_pvalues", f"SELECT feature, {r('least(1, greatest(0, p))', 'ks_pvalue')}, ks >= 0.2 AS strong FROM ks_tails",
       **drift_sql(HISTORY_COHORTS, HISTORY_FEATURES), ks_sizes=KS_SIZES, ks_tails=KS_TAILS)
def _(data):
    report = drift.temporal_drift_report(data.history, method="asymptotic")
    return report.select("feature", "ks_pvalue", "strong")


@query("T2_top_drift", f"SELECT {drift_select()} FROM drift_rows ORDER BY ks DESC, abs(mr - mb) DESC, feature LIMIT 10",
       **drift_sql(HISTORY_COHORTS, HISTORY_FEATURES))
def _(data):
    top = drift.temporal_drift(data.history).orderBy(*drift.drift_order()).limit(10)
    return to_four(top, MEANS).drop("baseline_rows", "recent_rows")


PAIR_NAMES = ["initial_balance", "outgoing_transaction_count", "incoming_transaction_count", "total_amount"]
PAIR = f"""SELECT initial_balance, coalesce(outgoing_transaction_count, 0) AS outgoing_transaction_count,
 coalesce(incoming_transaction_count, 0) AS incoming_transaction_count,
 (coalesce(outgoing_amount_total, 0) + coalesce(incoming_amount_total, 0)) * factor AS total_amount, cohort
 FROM nodes LEFT JOIN out_flow USING (node_id) LEFT JOIN in_flow USING (node_id),
 (SELECT 'baseline' AS cohort, 1.0::DOUBLE AS factor UNION ALL SELECT 'recent', 5.0)"""


@query("D5_distribution_drift", f"SELECT {drift_select(2)}, ks >= 0.2 AS drifted FROM drift_rows",
       **FLOW_VIEWS, **drift_sql(PAIR, PAIR_NAMES))
def _(data):
    baseline, recent = data.drift_pair
    rows = drift.distribution_drift(baseline, recent, columns=PAIR_NAMES)
    return rows.withColumns({m: F.round(m, 2) for m in MEANS}).drop("ks_pvalue", "baseline_rows", "recent_rows")


@query("D5_verdict_pvalues", f"SELECT feature, {r('least(1, greatest(0, p))', 'ks_pvalue')}, ks >= 0.2 AND p <= 0.05 AS drifted FROM ks_tails",
       **FLOW_VIEWS, **drift_sql(PAIR, PAIR_NAMES), ks_sizes=KS_SIZES, ks_tails=KS_TAILS)
def _(data):
    baseline, recent = data.drift_pair
    rows = drift.distribution_drift(baseline, recent, columns=PAIR_NAMES, method="asymptotic")
    return rows.select("feature", "ks_pvalue", "drifted")


@query("D6_activity_summary", f"""
SELECT 'party' AS kind, * FROM (SELECT p.party_id AS id, outgoing_count_recent_30::DOUBLE AS value, p.is_alerted::INTEGER AS
 label FROM parties p JOIN out_party_time o ON p.party_id = o.party_id ORDER BY 2 DESC, 1 LIMIT 10) UNION ALL
SELECT 'transaction', * FROM (SELECT transaction_id, {r('source_account_velocity_ratio_1_to_30', 'v')},
 is_alert_related::INTEGER FROM history ORDER BY source_account_velocity_ratio_1_to_30 DESC, transaction_id LIMIT 10)""",
       **PARTY_VIEWS)
def _(data):
    # not stored: of the fifty columns of a transaction, four are ranked, and only those move
    summary = drift.activity_summary(data.tables, data.feature_sets, WINDOWS)
    party = summary["top_parties_by_recent_outgoing_activity"].select(
        F.lit("party").alias("kind"), F.col("party_id").alias("id"),
        F.col("outgoing_count_recent_30").cast("double").alias("value"), "label")
    velocity = summary["top_transactions_by_velocity"].select(
        F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id"),
        F.col("source_account_velocity_ratio_1_to_30").alias("value"), "label")
    return party.unionByName(velocity)


@query("D7_perturbation", f"""
SELECT p_partkey, {r('p_retailprice * 5.0', 'p_retailprice')}, p_size FROM part""")
def _(data):
    rows = data.table("part").select("p_partkey", "p_retailprice", "p_size")
    return drift.perturbed(rows, ["p_retailprice"], 5.0)


