"""Sources and sinks, projections, joins, ordering, scalar functions, canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import columns as X
from riskloom.functions.ordered import keep_first
from riskloom.operators import canonical as canon, drift, enrich, features, flows, graph as graphs, iterative, metrics, quality, scoring
from riskloom.plans import canonical, domain
from riskloom.plans.oracle import bucket, money, r
from riskloom.plans.registry import query
from riskloom.session import materialise, work_path
from riskloom.sources import archives, files
from riskloom.streaming import jobs

RAW_TRANSFERS = """
SELECT transaction_id AS tran_id, source_account_id AS orig_acct, destination_account_id AS bene_acct,
       transaction_type AS tx_type, amount AS base_amt, event_step AS start FROM moves WHERE NOT is_cash"""


# ---- sources and sinks ------------------------------------------------------------------------


def _write_raw(data, *names: str) -> str:
    root = work_path(data.spark, "raw")
    file_names = files.CONVERTED_FILES
    for name in names:
        data.raw[name].drop(canon.INGEST).write.option("header", True).csv(f"{root}/outputs/{file_names[name]}")
    return root


@query("S1_raw_layout_scan", RAW_TRANSFERS)
def _(data):
    root = _write_raw(data, "accounts", "transactions", "alerts", "cash_transactions", "alert_transactions")
    _, raw = files.read_raw_tables(data.spark, root, sample_preferred=False)
    t = raw["transactions"]
    return t.select(
        "tran_id", "orig_acct", "bene_acct", "tx_type", X.number(F.col("base_amt")).alias("base_amt"),
        X.whole(X.number(F.col("start"))).alias("start"),
    )


@query(
    "S2_missing_optional_table",
    "SELECT account_id, party_id, false AS is_alerted, 0::BIGINT AS alert_count FROM accounts",
)
def _(data):
    root = _write_raw(data, "accounts", "transactions")
    layout, raw = files.read_raw_tables(data.spark, root)
    accounts = canonical.canonical_tables(raw, layout.name)["accounts"]
    return accounts.select("account_id", "party_id", "is_alerted", "alert_count")


TABLES = ("accounts", "parties", "transactions", "alerts", "banks", "devices", "ip_addresses", "merchants",
          "account_device_links", "account_ip_links", "transaction_merchant_links")


@query("S3_processed_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def _(data):
    root = work_path(data.spark, "processed")
    files.write_tables(data.tables, root)
    return quality.row_counts(files.read_processed_tables(data.spark, root))


CANONICAL_TRANSACTIONS = """
SELECT transaction_id, source_account_id, destination_account_id, transaction_type, amount, event_step,
       event_timestamp, is_cash, layout_name, source_party_id, destination_party_id, is_alert_related, label_source,
       source_type FROM transactions"""


@query("S4_write_bundle", CANONICAL_TRANSACTIONS)
def _(data):
    root = work_path(data.spark, "bundle")
    files.write_tables({"transactions": data.transactions}, root, partition_by=["layout_name"])
    return files.read_processed_tables(data.spark, root)["transactions"].select(data.transactions.columns)


@query("S5_chunked_stream", RAW_TRANSFERS)
def _(data):
    root = work_path(data.spark, "chunks")
    names = ["tran_id", "orig_acct", "bene_acct", "tx_type", "base_amt", "start"]
    data.raw["transactions"].select(names).write.option("header", True).csv(root)
    schema = "tran_id string, orig_acct string, bene_acct string, tx_type string, base_amt double, start bigint"
    stream = jobs.stream_files(data.spark, root, schema, files_per_trigger=4)
    return jobs.ingest(stream, work_path(data.spark, "ingested"), work_path(data.spark, "offsets"))


def _archive_folder(data) -> str:
    root = work_path(data.spark, "archive")
    nodes, transfers = data.archive["nodes"], data.archive["transactions"].drop("id")
    nodes.write.option("header", True).csv(f"{root}/nodes.csv")
    transfers.write.option("header", True).csv(f"{root}/transactions.csv")
    counts = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("isFraud") == "1").alias("f"))
    text = F.concat(
        F.lit("nodes: "), F.format_number("n", 0), F.lit(" ("), F.col("f"), F.lit(" fraud nodes) transactions: "),
        F.format_number("m", 0), F.lit(" patterns: derived"),
    )
    counts.withColumn("m", transfers.agg(F.count("*")).scalar()).select(text.alias("value")).write.text(
        f"{root}/metadata.txt"
    )
    return root


@query("S6_archive_source", "SELECT source_node_id, target_node_id, amount, event_time FROM transfers")
def _(data):
    archive = files.read_archive(data.spark, _archive_folder(data))
    nodes = flows.archive_nodes(archive["nodes"])
    return flows.archive_transactions(archive["transactions"], nodes).drop("transaction_id", "transaction_type_code")


@query("S6_packed_archives", "SELECT source_node_id, target_node_id, amount, event_time FROM transfers")
def _(data):
    """The archive packed into several .tar.gz files, and read from them."""
    nodes, transactions = data.archive["nodes"], data.archive["transactions"].drop("id")
    manifest = archives.write_packed_archives(nodes, transactions, work_path(data.spark, "packed"), parts=8)
    paths = [row["path"] for row in manifest.select("path").collect()]  # one of each part
    archive = archives.read_packed_archives(data.spark, paths)
    known = flows.archive_nodes(archive["nodes"].drop("archive"))
    rows = flows.archive_transactions(archive["transactions"].drop("archive"), known)
    return rows.drop("transaction_id", "transaction_type_code")


@query("S7_metadata_reconcile", """
SELECT 'node_count' AS quantity, count(*) AS reported, count(*) AS actual, true AS matches FROM nodes UNION ALL
SELECT 'fraud_node_count', sum(is_fraud)::BIGINT, sum(is_fraud)::BIGINT, true FROM nodes UNION ALL
SELECT 'transaction_count', count(*), count(*), true FROM transfers""")
def _(data):
    archive = files.read_archive(data.spark, _archive_folder(data))
    return files.reconcile_metadata(archive["metadata"], archive["nodes"], archive["transactions"])


@query("S8_report_sink", """
SELECT event_step, count(*) AS transaction_count, count(*) FILTER (WHERE is_alert_related) AS alert_related_count
FROM transactions GROUP BY event_step""")
def _(data):
    path = work_path(data.spark, "report")
    files.write_report(drift.activity_by_step(data.transactions), path)
    ddl = "event_step bigint, transaction_count bigint, alert_related_count bigint"
    return data.spark.read.schema(ddl).json(path)


@query("S8_all_reports", """
SELECT unnest(['activity', 'drift', 'graph_summary', 'metrics', 'profile', 'validation']) AS report, 0 AS lost, 0 AS added""")
def _(data):
    """All reports through the sink; what comes back is compared with what was written, row by row."""
    graph_rows = graphs.graph_summary(data.graph, iterative.connected_components(data.graph), graphs.clustering(data.graph))
    reports = {
        "validation": quality.validation_report(data.tables),
        "profile": quality.profile_report(data.tables),
        "drift": drift.temporal_drift_report(data.history),
        "activity": drift.activity_by_step(data.transactions),
        "graph_summary": graph_rows,
        "metrics": metrics.threshold_metrics(scored_accounts(data)),
    }
    reports = {name: materialise(rows, name) for name, rows in reports.items()}
    root = work_path(data.spark, "reports")
    files.write_reports(reports, root)
    rows = []
    for name, written in reports.items():
        found = files.read_report(data.spark, root, name, written.schema)
        sides = written.withColumn("_side", F.lit(1)).unionByName(found.withColumn("_side", F.lit(-1)))
        balance = sides.groupBy(*written.columns).agg(F.sum("_side").alias("n"))
        counts = [F.coalesce(F.sum(F.greatest(sign * F.col("n"), F.lit(0))), F.lit(0)).cast("int") for sign in (1, -1)]
        rows.append(balance.agg(counts[0].alias("lost"), counts[1].alias("added")).withColumn("report", F.lit(name)))
    return quality.union_all(rows)


@query("S9_feature_sink", f"""
SELECT source_account_id, count(*) AS outgoing_transaction_count, {r("sum(" + money("amount") + ")", "outgoing_amount_total")}
FROM transactions GROUP BY source_account_id""")
def _(data):
    path = work_path(data.spark, "features")
    profile = features.outgoing_profile(data.transactions, "source_account_id").drop("unique_destinations")
    files.write_features(profile, path, as_csv=True)
    return data.spark.read.option("header", True).schema(profile.schema).csv(path)


# ---- projections, coercions, predicates -------------------------------------------------------


@query("P1_find_column", "SELECT c_custkey AS found_key, c_acctbal AS found_balance FROM customer")
def _(data):
    customer = data.table("customer")
    key = X.find_column(customer, "ACCOUNT_ID", "C_CUSTKEY")
    balance = X.find_column(customer, "balance", "C_AcctBal")
    return customer.select(F.col(key).alias("found_key"), F.col(balance).alias("found_balance"))


@query("P2_text_column", """
SELECT account_id, CASE WHEN start_step = 0 THEN '' ELSE 'P_' || (account_id::BIGINT // 2) END AS owner,
 'unknown' AS absent, CASE WHEN initial_balance < -500 THEN 'Yes' WHEN initial_balance > 9000 THEN '1.0' ELSE 'false' END
 AS word FROM accounts""")
def _(data):
    raw = data.raw["accounts"]
    return raw.select(
        X.text_column(raw, "acct_id").alias("account_id"),
        X.text_column(raw, "PRIMARY_CUSTOMER_ID", "cust_id").alias("owner"),
        X.text_column(raw, "no_such_column", default="unknown").alias("absent"),
        X.text_column(raw, "suspicious").alias("word"),
    )


@query("P3_number_column", """
SELECT account_id, initial_balance AS balance, CASE WHEN business_type = 'BUILDING' THEN -1.0 ELSE start_step * 10 + 0.5
 END::DOUBLE AS end_day, 7.0::DOUBLE AS absent FROM accounts""")
def _(data):
    raw = data.raw["accounts"]
    return raw.select(
        F.col("acct_id").alias("account_id"),
        X.number_column(raw, "INIT_BALANCE").alias("balance"),
        X.number_column(raw, "end", default=-1.0).alias("end_day"),
        X.number_column(raw, "no_such_column", default=7.0).alias("absent"),
    )


@query("P4_flag_column", "SELECT account_id, source_suspicious_flag AS flag, true AS absent FROM accounts")
def _(data):
    raw = data.raw["accounts"]
    return raw.select(
        F.col("acct_id").alias("account_id"),
        X.flag_column(raw, "suspicious").alias("flag"),
        X.flag_column(raw, "no_such_column", default=True).alias("absent"),
    )


@query("P5_whole_column", "SELECT account_id, end_step, trunc(initial_balance)::BIGINT AS whole_balance FROM accounts")
def _(data):
    raw = data.raw["accounts"]
    return raw.select(
        F.col("acct_id").alias("account_id"),
        X.whole_column(raw, "end").alias("end_step"),
        X.whole_column(raw, "init_balance").alias("whole_balance"),
    )


@query("P6_lineage_columns", """
SELECT layout_name, source_type, count(*) AS row_count FROM transactions GROUP BY ALL UNION ALL
SELECT layout_name, source_type, count(*) FROM parties GROUP BY ALL""")
def _(data):
    names = ["layout_name", "source_type"]
    return quality.union_all(
        [data.fresh[t].groupBy(*names).agg(F.count("*").alias("row_count")) for t in ("transactions", "parties")]
    )


@query("P7_rename_required", "SELECT node_id, is_fraud, initial_balance, fraud_step FROM nodes")
def _(data):
    return flows.archive_nodes(data.archive["nodes"])


@query("P8_prefix_projection", """
SELECT account_id AS source_account_id, initial_balance AS source_initial_balance, is_alerted AS source_is_alerted
FROM accounts""")
def _(data):
    return X.with_prefix(data.tables["accounts"], "source_", ["account_id", "initial_balance", "is_alerted"])


@query("P9_row_filters", """
SELECT transaction_id, event_step, amount FROM transactions WHERE destination_party_id IS NOT NULL
AND event_step >= (SELECT max(event_step) FROM transactions) - 29 AND event_step <= (SELECT max(event_step) FROM
transactions) - 7""")
def _(data):
    latest = data.transactions.agg(F.max("event_step")).scalar()
    present = data.transactions.dropna(subset=["destination_party_id"])
    return present.where(
        (F.col("event_step") >= latest - 29) & (F.col("event_step") <= latest - 7)
    ).select("transaction_id", "event_step", "amount")


@query("P10_fill_numbers", """
SELECT n.node_id, coalesce(x.in_count, 0) AS in_count, m.tag FROM nodes n
LEFT JOIN (SELECT target_node_id, count(*) AS in_count FROM transfers GROUP BY 1) x ON n.node_id = x.target_node_id
LEFT JOIN (SELECT node_id, 'fraud' AS tag FROM nodes WHERE is_fraud = 1) m ON m.node_id = n.node_id""")
def _(data):
    counts = data.transfers.groupBy(F.col("target_node_id").alias("node_id")).agg(F.count("*").alias("in_count"))
    tags = data.nodes.where("is_fraud = 1").select("node_id", F.lit("fraud").alias("tag"))
    joined = data.nodes.select("node_id").join(counts, "node_id", "left").join(tags, "node_id", "left")
    return X.fill_numbers(joined)


@query("P11_label_precedence", "SELECT label_source, is_alert_related, count(*) AS n FROM transactions GROUP BY ALL")
def _(data):
    return data.fresh["transactions"].groupBy("label_source", "is_alert_related").agg(F.count("*").alias("n"))


@query("P12_feature_selection", "SELECT feature, count(*) AS n FROM (SELECT " + ", ".join(
    f"user_{n}" for n in ("previous_gap", "count_prev_1", "amount_prev_1", "count_prev_7", "amount_prev_7",
                          "count_prev_30", "amount_prev_30", "velocity_ratio_1_to_30", "amount_ratio_1_to_30")
) + " FROM event_history) h UNPIVOT (value FOR feature IN (user_previous_gap, user_count_prev_1, user_amount_prev_1, "
    "user_count_prev_7, user_amount_prev_7, user_count_prev_30, user_amount_prev_30, user_velocity_ratio_1_to_30, "
    "user_amount_ratio_1_to_30)) GROUP BY feature")
def _(data):
    from riskloom.operators.trailing import add_trailing_history

    rows = add_trailing_history(data.events, "source_account_id", "user", ids=("transaction_id",))
    chosen = drift.temporal_feature_columns(rows)
    return drift.melted(rows, chosen, ids=()).groupBy("feature").agg(F.count("*").alias("n"))


@query("P13_melt", f"""
SELECT feature, count(*) AS n, {r("sum(" + money("value") + ")", "total")} FROM
(SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)) GROUP BY feature""")
def _(data):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = drift.melted(data.table("lineitem"), names, ids=())
    return long.groupBy("feature").agg(
        F.count("*").alias("n"), X.money_sum(F.col("value")).cast("double").alias("total")
    )


# ---- joins ------------------------------------------------------------------------------------


@query("J1_party_lookup", "SELECT transaction_id, source_party_id, destination_party_id FROM transactions")
def _(data):
    return data.fresh["transactions"].select("transaction_id", "source_party_id", "destination_party_id")


@query("J2_membership_flags", "SELECT account_id, is_alerted, alert_count FROM accounts")
def _(data):
    return data.fresh["accounts"].select("account_id", "is_alerted", "alert_count")


@query("J3_semi_join", "SELECT transaction_id, source_node_id, target_node_id FROM transfers")
def _(data):
    rows = flows.archive_transactions(data.archive["transactions"], data.nodes, id_column="id")
    return rows.select("transaction_id", "source_node_id", "target_node_id")


@query("J4_anti_join", """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN
(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""")
def _(data):
    known = data.table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    values = data.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return values.join(known, "l_orderkey", "left_anti")


@query("J5_profile_join", """
SELECT t.transaction_id, o.n AS outgoing_transaction_count, coalesce(i.n, 0) AS incoming_transaction_count
FROM transactions t LEFT JOIN (SELECT source_account_id, count(*) AS n FROM transactions GROUP BY 1) o
USING (source_account_id) LEFT JOIN (SELECT destination_account_id, count(*) AS n FROM transactions GROUP BY 1) i
ON t.destination_account_id = i.destination_account_id""")
def _(data):
    t = data.transactions
    out = features.outgoing_profile(t, "source_account_id")
    into = features.incoming_profile(t, "destination_account_id")
    joined = t.join(out, "source_account_id", "left").join(into, "destination_account_id", "left")
    return joined.select(
        "transaction_id", "outgoing_transaction_count",
        F.coalesce("incoming_transaction_count", F.lit(0)).alias("incoming_transaction_count"),
    )


@query("J6_two_role_join", """
SELECT t.transaction_id, s.initial_balance AS source_initial_balance, s.is_alerted AS source_is_alerted,
 d.initial_balance AS destination_initial_balance, d.is_alerted AS destination_is_alerted FROM transactions t
LEFT JOIN accounts s ON t.source_account_id = s.account_id LEFT JOIN accounts d ON t.destination_account_id = d.account_id""")
def _(data):
    names = ["account_id", "initial_balance", "is_alerted"]
    joined = data.transactions
    for role in ("source", "destination"):
        joined = joined.join(X.with_prefix(data.tables["accounts"], f"{role}_", names), f"{role}_account_id", "left")
    return joined.select(
        "transaction_id", *[f"{r}_{n}" for r in ("source", "destination") for n in ("initial_balance", "is_alerted")]
    )


@query("J7_link_join", """
SELECT a.party_id, count(DISTINCT l.device_id) AS device_count FROM account_device_links l JOIN accounts a
USING (account_id) GROUP BY a.party_id""")
def _(data):
    links = data.tables["account_device_links"]
    return features.links_per_party(links, data.tables["accounts"], "device_id", "device_count")


@query("J8_feature_assembly", """
SELECT p.party_id, p.account_count, coalesce(o.n, 0) AS sent, coalesce(i.n, 0) AS received FROM parties p
LEFT JOIN (SELECT source_party_id, count(*) AS n FROM transactions GROUP BY 1) o ON p.party_id = o.source_party_id
LEFT JOIN (SELECT destination_party_id, count(*) AS n FROM transactions GROUP BY 1) i
ON p.party_id = i.destination_party_id""")
def _(data):
    t = data.transactions
    parts = [
        t.groupBy(F.col("source_party_id").alias("party_id")).agg(F.count("*").alias("sent")),
        t.groupBy(F.col("destination_party_id").alias("party_id")).agg(F.count("*").alias("received")),
    ]
    joined = data.tables["parties"].select("party_id", "account_count")
    for part in parts:
        joined = joined.join(part, "party_id", "left")
    return X.fill_numbers(joined)


@query("J9_embedding_labels", """
SELECT e.vec_id, list_sum(e.embedding::DOUBLE[]) > 0 AS positive_sum, coalesce(l.toxic, -1)::BIGINT AS toxic
FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id""")
def _(data):
    labels = data.table("labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    joined = data.table("embeddings").join(labels, "vec_id", "left")
    return joined.select(
        "vec_id", (total > 0).alias("positive_sum"), F.coalesce("toxic", F.lit(-1)).cast("bigint").alias("toxic")
    )


@query("J10_endpoint_resolution", """
SELECT source_node_id::VARCHAR AS source_id, target_node_id::VARCHAR AS target_id, transaction_id FROM transfers""")
def _(data):
    edges = data.typed_edges
    return edges.where("relation = 'account->transfers->account'").select("source_id", "target_id", "transaction_id")



CONFUSION = f"""
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp,
 count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
 count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn,
 count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn
FROM scored, (SELECT unnest([{', '.join(str(t) for t in metrics.THRESHOLDS)}])::DOUBLE AS threshold) GROUP BY threshold"""


def scored_accounts(data):
    """A deterministic score, so that metrics can be compared without a trained model."""
    score = F.round((F.col("c_nationkey") * 41 % 100) / 100.0, 2)
    return data.table("customer").select(
        F.col("c_custkey").alias("account_id"), (F.col("c_acctbal") < 0).cast("int").alias("label"),
        score.cast("double").alias("score"),
    )


@query("J11_threshold_grid", CONFUSION)
def _(data):
    return metrics.threshold_metrics(scored_accounts(data)).select("threshold", "tp", "fp", "fn", "tn")


# ---- sort, limit, dedupe, set operations ------------------------------------------------------


@query("T1_top_k", """
SELECT merchant_id, transaction_count FROM merchants ORDER BY transaction_count DESC, merchant_id LIMIT 10""")
def _(data):
    return quality.top_rows(data.tables["merchants"], "transaction_count", "merchant_id").select(
        "merchant_id", "transaction_count"
    )


@query("T3_top_k_per_account", """
SELECT account_id, rank, transaction_id, amount FROM (SELECT source_account_id AS account_id, transaction_id, amount,
 row_number() OVER (PARTITION BY source_account_id ORDER BY amount DESC, tid) AS rank FROM transactions) WHERE rank <= 3""")
def _(data):
    from riskloom.functions.ordered import top_per_group

    rows = data.transactions.select(F.col("source_account_id").alias("account_id"), "transaction_id", "amount")
    order = [F.desc("amount"), F.col("transaction_id").cast("bigint")]
    return top_per_group(rows, ["account_id"], order, 3)


@query("T4_risk_queue", f"""
SELECT account_id, event_id, {r("fraud_probability", "fraud_probability")} FROM (SELECT user_id AS account_id, event_id,
 value / 1000.0 AS fraud_probability, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events)
WHERE k = 1 ORDER BY fraud_probability DESC, account_id LIMIT 8""")
def _(data):
    predictions = data.table("events").select(
        F.col("user_id").alias("account_id"), "event_id", (F.col("value") / 1000.0).alias("fraud_probability")
    )
    return scoring.risk_queue(predictions, order="event_id")


@query("T5_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,
 l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def _(data):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    first = keep_first(data.table("lineitem"), ["l_orderkey", "l_linenumber"], order)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("T6_distinct", "SELECT DISTINCT bank_id, country_code FROM accounts")
def _(data):
    return data.fresh["accounts"].select("bank_id", "country_code").distinct()


@query("T7_union_all", """
SELECT is_cash, count(*) AS n, count(destination_account_id) AS with_destination FROM moves GROUP BY is_cash""")
def _(data):
    parts = [
        canon.movements(data.raw[name], domain.LAYOUT, cash=cash)
        for name, cash in (("transactions", False), ("cash_transactions", True))
    ]
    return quality.union_all(parts).groupBy("is_cash").agg(
        F.count("*").alias("n"), F.count("destination_account_id").alias("with_destination")
    )


@query("T8_column_difference", """
SELECT column_name, present FROM (SELECT count(alert_type) AS alert_type, count(alert_id) AS alert_id,
 count(event_value) AS event_value, count(is_sar) AS is_sar FROM alerts)
UNPIVOT (present FOR column_name IN (alert_type, alert_id, event_value, is_sar))""")
def _(data):
    alerts = data.tables["alerts"]
    extra = [c for c in alerts.columns if c not in set(data.tables["parties"].columns) | {"account_id"}]
    counted = alerts.agg(*[F.count(c).alias(c) for c in extra])
    return counted.unpivot([], extra, "column_name", "present")


@query("T8_required_columns", """
SELECT 'accounts' AS table_name, '' AS missing, count(*) AS rows FROM accounts UNION ALL
SELECT 'parties', 'alert_type, event_value', count(*) FROM parties""")
def _(data):
    """Two columns that only alerts have: an error that names them for parties, none where all are there."""
    asked = {"accounts": ("account_id", "party_id"), "parties": ("party_id", "alert_type", "event_value")}
    counted = []
    for name, wanted in asked.items():
        missing = ""
        try:
            X.require_columns(data.tables[name], wanted, name)
        except KeyError as error:
            missing = str(error.args[0]).rsplit("columns ", 1)[1]
        rows = data.tables[name].agg(F.count("*").alias("rows"))
        counted.append(rows.select(F.lit(name).alias("table_name"), F.lit(missing).alias("missing"), "rows"))
    return quality.union_all(counted)


@query("V5_required_report", """
SELECT 'accounts' AS table_name, true AS passed, '' AS missing_columns, count(*) AS rows FROM accounts UNION ALL
SELECT 'alerts', false, 'party_id', count(*) FROM alerts UNION ALL SELECT 'parties', true, '', count(*) FROM parties UNION ALL
SELECT 'transactions', true, '', count(*) FROM transactions""")
def _(data):
    """The check of required columns over the canonical tables, one of which has lost a column."""
    tables = data.tables | {"alerts": data.tables["alerts"].drop("party_id")}
    checked = quality.required_columns(tables)
    counted = [tables[n].agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(n)) for n in quality.REQUIRED_COLUMNS]
    return checked.join(quality.union_all(counted), "table_name")


# ---- scalar functions -------------------------------------------------------------------------


@query("X1_stable_hash_bucket", f"""
SELECT p_partkey, {bucket('p_partkey::VARCHAR', "'17'", '16', 'device')} AS bucket_16,
 {bucket("p_name || ':' || p_type", "'317'", '24', 'merchant')} AS bucket_24 FROM part""")
def _(data):
    return data.table("part").select(
        "p_partkey",
        X.hash_bucket(F.col("p_partkey"), 17, 16, "device").alias("bucket_16"),
        X.hash_bucket(F.concat_ws(":", "p_name", "p_type"), 317, 24, "merchant").alias("bucket_24"),
    )


@query("X2_trailing_digits", """
SELECT c_name, CASE WHEN regexp_extract(c_name, '(\\d+)$', 1) = '' THEN '0' ELSE regexp_extract(c_name, '(\\d+)$', 1) END
 AS digits, '0' AS none FROM customer""")
def _(data):
    return data.table("customer").select(
        "c_name", X.trailing_digits(F.col("c_name")).alias("digits"),
        X.trailing_digits(F.concat("c_mktsegment", F.lit("!"))).alias("none"),
    )


@query("X3_segment_code", f"""
SELECT transaction_id, {r("1.0 + merchant_segment / 23.0", "transaction_type_code")} FROM archive_links""")
def _(data):
    return data.merchant_links.select("transaction_id", "transaction_type_code")


@query("X4_clip", "SELECT account_id, greatest(end_step - 100, 0) AS excess FROM accounts")
def _(data):
    return data.tables["accounts"].select(
        "account_id", X.at_least_zero(F.col("end_step") - 100).alias("excess")
    )


@query("X5_relative_change", f"""
SELECT party_id, {r("CASE WHEN b = 0 THEN 0 ELSE (a - b) / abs(b) END", "change")} FROM
(SELECT party_id, sum(CASE WHEN is_alerted THEN 1.0 ELSE 0 END) AS b, count(*) AS a FROM accounts GROUP BY 1)""")
def _(data):
    grouped = data.tables["accounts"].groupBy("party_id").agg(
        F.count_if("is_alerted").cast("double").alias("b"), F.count("*").cast("double").alias("a")
    )
    return grouped.select("party_id", X.relative_change(F.col("b"), F.col("a")).alias("change"))


@query("X6_text_fallback", """
SELECT account_id, party_id FROM accounts""")
def _(data):
    return data.fresh["accounts"].select("account_id", "party_id")


@query("X7_z_score", f"""
SELECT p_partkey, {r("(p_retailprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END", "p_retailprice", 5)}, {r("(one - 1.0)", "one")}
FROM (SELECT *, 1.0 AS one FROM part), (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)""")
def _(data):
    rows = data.table("part").withColumn("one", F.lit(1.0)).select("p_partkey", "p_retailprice", "one")
    scaled = scoring.standardise(rows, ["p_retailprice", "one"])
    return scaled.withColumn("p_retailprice", F.round("p_retailprice", 5))


@query("X8_threshold_decision", """
SELECT account_id, score AS fraud_probability, score >= 0.5 AS is_high_risk, 0.5::DOUBLE AS threshold_used FROM scored""")
def _(data):
    scores = scored_accounts(data).select("account_id", F.col("score").alias("fraud_probability"))
    return scoring.decide(scores, 0.5)


# ---- canonical tables -------------------------------------------------------------------------


@query("C1_accounts", "SELECT * FROM accounts")
def _(data):
    return data.fresh["accounts"]


@query("C2_alerts", "SELECT * FROM alerts")
def _(data):
    return data.fresh["alerts"]


@query("C3_parties", "SELECT * FROM parties")
def _(data):
    return data.fresh["parties"]


@query("C4_banks", "SELECT * FROM banks")
def _(data):
    return data.fresh["banks"]


@query("C5_transactions", CANONICAL_TRANSACTIONS)
def _(data):
    return data.fresh["transactions"]


@query("C6_label_lineage", "SELECT transaction_id, is_cash, is_alert_related, label_source FROM transactions")
def _(data):
    return data.fresh["transactions"].select("transaction_id", "is_cash", "is_alert_related", "label_source")


@query("C7_device_links", "SELECT * FROM account_device_links JOIN devices USING (device_id)")
def _(data):
    links = enrich.device_links(data.tables["accounts"])
    return links.join(enrich.devices(links), "device_id")


@query("C8_ip_links", "SELECT * FROM account_ip_links JOIN ip_addresses USING (ip_id)")
def _(data):
    links = enrich.address_links(data.tables["accounts"])
    return links.join(enrich.addresses(links), "ip_id")


@query("C9_merchant_links", "SELECT * FROM transaction_merchant_links JOIN merchants USING (merchant_id)")
def _(data):
    links = enrich.merchant_links(data.transactions)
    return links.join(enrich.merchants(links), "merchant_id")


@query("C10_archive_nodes", "SELECT * FROM nodes")
def _(data):
    return flows.archive_nodes(data.archive["nodes"])


@query("C11_archive_transactions", "SELECT * FROM transfers")
def _(data):
    return flows.archive_transactions(data.archive["transactions"], data.nodes, id_column="id")


@query("C12_archive_merchant_links", f"""
SELECT *, {r("1.0 + merchant_segment / 23.0", "transaction_type_code")} FROM archive_links""")
def _(data):
    return data.merchant_links


@query("C13_canonical_bundle", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
    for t in ("accounts", "parties", "transactions", "alerts", "banks", "devices", "ip_addresses", "merchants",
              "account_device_links", "account_ip_links", "transaction_merchant_links")))
def _(data):
    return quality.row_counts(data.fresh)


