"""Raw account, alert and transaction tables -> canonical tables.

Raw columns are found by name among accepted candidates; text is coerced tolerantly. Absent keys
become NULL, so they neither join nor form groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import (
    find_column,
    flag_column,
    left_lookup,
    null_if_blank,
    number_column,
    text_column,
    whole_column,
)
from riskloom.functions.ordered import keep_first

INGEST = "_ingest_order"

# Accepted raw column names, in order of preference
ACCOUNT_ID = ("ACCOUNT_ID", "acct_id")
OWNER_ID = ("PRIMARY_CUSTOMER_ID", "cust_id", "partyId")
ALERT_PARTY = ("CUSTOMER_ID", "cust_id", "partyId")
ORIGIN = ("ACCOUNT_ID", "orig_acct")
TRANSACTION_ID = ("TXN_ID", "tran_id")


def _ingest_order(raw: DataFrame):
    """Order of arrival for keep-first dedupe: an explicit column when the source provides one."""
    return F.col(INGEST) if find_column(raw, INGEST) else F.monotonically_increasing_id()


def alerts_per_account(raw_alerts: DataFrame) -> DataFrame:
    return (
        raw_alerts.select(null_if_blank(text_column(raw_alerts, *ACCOUNT_ID)).alias("account_id"))
        .where(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(F.count("*").alias("alert_count"))
    )


def canonical_accounts(raw_accounts: DataFrame, raw_alerts: DataFrame, layout_name: str) -> DataFrame:
    account_id = text_column(raw_accounts, *ACCOUNT_ID)
    party = null_if_blank(text_column(raw_accounts, *OWNER_ID))
    selected = raw_accounts.select(
        account_id.alias("account_id"),
        F.coalesce(party, F.concat(F.lit("party_"), account_id)).alias("party_id"),
        text_column(raw_accounts, "bank_id", default="bank_default").alias("bank_id"),
        text_column(raw_accounts, "country", default="US").alias("country_code"),
        text_column(raw_accounts, "business", "business_type", "type", default="unknown").alias("business_type"),
        number_column(raw_accounts, "init_balance", "initial_deposit").alias("initial_balance"),
        whole_column(raw_accounts, "start", "start_day", "open_dt").alias("start_step"),
        whole_column(raw_accounts, "end", "end_day", "close_dt").alias("end_step"),
        flag_column(raw_accounts, "suspicious", "prior_sar_count", "isFraud").alias("source_suspicious_flag"),
        whole_column(raw_accounts, "modelID", "tx_behavior_id").alias("model_id"),
        F.lit(layout_name).alias("layout_name"),
        F.lit("source_native").alias("source_type"),
        _ingest_order(raw_accounts).alias(INGEST),
    )
    accounts = keep_first(selected, ["account_id"], [INGEST]).drop(INGEST)
    counted = accounts.join(alerts_per_account(raw_alerts), "account_id", "left")
    return counted.select(
        *accounts.columns,
        F.col("alert_count").isNotNull().alias("is_alerted"),
        F.coalesce("alert_count", F.lit(0)).cast("bigint").alias("alert_count"),
    )


def canonical_alerts(raw_alerts: DataFrame, accounts: DataFrame, layout_name: str) -> DataFrame:
    """A party id that is blank or not a known account owner is replaced by the account's owner."""
    alerts = raw_alerts.select(
        text_column(raw_alerts, "ALERT_KEY", "alert_id").alias("alert_id"),
        text_column(raw_alerts, "CHECK_NAME", "alert_type", "ALERT_TEXT", default="unknown").alias("alert_type"),
        null_if_blank(text_column(raw_alerts, *ACCOUNT_ID)).alias("account_id"),
        null_if_blank(text_column(raw_alerts, *ALERT_PARTY)).alias("stated_party"),
        text_column(raw_alerts, "EVENT_DATE", "start", "tran_timestamp").alias("event_value"),
        flag_column(raw_alerts, "is_sar", "Escalated_To_Case_Investigation", default=True).alias("is_sar"),
        F.lit(layout_name).alias("layout_name"),
    )
    owners = accounts.select("account_id", F.col("party_id").alias("owner"))
    known = accounts.select(F.col("party_id").alias("stated_party"), F.lit(True).alias("known")).distinct()
    resolved = alerts.join(known, "stated_party", "left").join(owners, "account_id", "left")
    return resolved.select(
        "alert_id",
        "alert_type",
        "account_id",
        F.when(F.col("known"), F.col("stated_party")).otherwise(F.col("owner")).alias("party_id"),
        "event_value",
        "is_sar",
        "layout_name",
    ).distinct()


def canonical_parties(accounts: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per party. A party seen in several countries takes that of its first account."""
    alert_counts = (
        alerts.where(F.col("party_id").isNotNull()).groupBy("party_id").agg(F.count("*").alias("alert_count"))
    )
    number = F.col("account_id").try_cast("bigint")
    order = [number.isNull(), number, F.col("account_id")]
    parties = keep_first(accounts.select("party_id", "country_code", "layout_name", "account_id"), ["party_id"], order)
    sizes = accounts.groupBy("party_id").agg(F.countDistinct("account_id").alias("account_count"))
    joined = parties.join(sizes, "party_id", "left").join(alert_counts, "party_id", "left")
    return joined.select(
        "party_id",
        "country_code",
        "layout_name",
        F.lit("individual").alias("party_type"),
        F.lit("source_native_or_sample_fallback").alias("source_type"),
        F.coalesce("account_count", F.lit(0)).cast("bigint").alias("account_count"),
        F.col("alert_count").isNotNull().alias("is_alerted"),
        F.coalesce("alert_count", F.lit(0)).cast("bigint").alias("alert_count"),
    )


def canonical_banks(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "bank_id", F.col("country_code").alias("country_hint"), F.lit("source_native").alias("source_type")
    ).distinct()


def movements(raw: DataFrame, layout_name: str, *, cash: bool) -> DataFrame:
    step_names = ("RUN_DATE", "start") if cash else ("start", "RUN_DATE")
    counterparty = F.lit("") if cash else text_column(raw, "COUNTER_PARTY_ACCOUNT_NUM", "bene_acct")
    kind = text_column(raw, "TXN_SOURCE_TYPE_CODE", "tx_type", default="CASH" if cash else "TRANSFER")
    return raw.select(
        text_column(raw, *TRANSACTION_ID).alias("transaction_id"),
        null_if_blank(text_column(raw, *ORIGIN)).alias("source_account_id"),
        null_if_blank(counterparty).alias("destination_account_id"),
        kind.alias("transaction_type"),
        number_column(raw, "TXN_AMOUNT_ORIG", "base_amt").alias("amount"),
        whole_column(raw, *step_names).alias("event_step"),
        null_if_blank(text_column(raw, "tran_timestamp")).alias("event_timestamp"),
        F.lit(cash).alias("is_cash"),
        F.lit(layout_name).alias("layout_name"),
        _ingest_order(raw).alias(INGEST),
    )


def account_directory(accounts: DataFrame, alerts: DataFrame) -> DataFrame:
    """account -> (party, alerted), including alerted ids that have no account row."""
    alerted = alerts.select("account_id", F.lit(True).alias("alerted")).where("account_id is not null").distinct()
    return accounts.select("account_id", "party_id").join(alerted, "account_id", "full_outer")


def direct_alert_ids(raw_alert_transactions: DataFrame) -> DataFrame:
    ids = null_if_blank(text_column(raw_alert_transactions, "tran_id", "TXN_ID"))
    return raw_alert_transactions.select(ids.alias("transaction_id")).where("transaction_id is not null").distinct()


def canonical_transactions(
    raw: dict[str, DataFrame], accounts: DataFrame, alerts: DataFrame, layout_name: str
) -> DataFrame:
    """Transfers and cash rows, first per (id, is_cash), with parties, label and label lineage."""
    moves = movements(raw["transactions"], layout_name, cash=False)
    if "cash_transactions" in raw:
        moves = moves.unionByName(movements(raw["cash_transactions"], layout_name, cash=True))
    moves = keep_first(moves, ["transaction_id", "is_cash"], [INGEST]).drop(INGEST)

    directory = account_directory(accounts, alerts)

    def role(name: str) -> DataFrame:
        return directory.select(
            F.col("account_id").alias(f"{name}_account_id"),
            F.col("party_id").alias(f"{name}_party_id"),
            F.col("alerted").alias(f"_{name}_alerted"),
        )

    joined = moves
    for name in ("source", "destination"):
        # all cash rows lack a destination
        joined = left_lookup(joined, role(name), f"{name}_account_id", ["transaction_id", "event_step", "amount"])
    if "alert_transactions" in raw:
        direct = direct_alert_ids(raw["alert_transactions"]).withColumn("_direct", F.lit(True))
        joined = joined.join(direct, "transaction_id", "left")
    else:
        joined = joined.withColumn("_direct", F.lit(None).cast("boolean"))
    is_direct = F.coalesce("_direct", F.lit(False))
    adjacent = F.coalesce("_source_alerted", F.lit(False)) | F.coalesce("_destination_alerted", F.lit(False))
    return joined.select(
        *moves.columns,
        "source_party_id",
        "destination_party_id",
        (is_direct | adjacent).alias("is_alert_related"),
        F.when(is_direct, "direct_alert_transaction")
        .when(adjacent, "alert_adjacent_account")
        .otherwise("none")
        .alias("label_source"),
        F.lit("source_native").alias("source_type"),
    )
