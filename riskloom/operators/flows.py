"""Archive graph inputs, account flow and velocity features, merchant features.

All aggregates are built bottom-up from one table of distinct (source, target) pairs: the transactions
are scanned once, distinct counterparties are plain row counts, and no group holds raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.columns import (
    at_least_zero,
    hash_bucket,
    money_sum,
    number,
    require_columns,
    segment_code,
    trailing_digits,
    whole,
)
from riskloom.functions.ordered import keep_first
from riskloom.operators.canonical import INGEST
from riskloom.operators.enrich import MERCHANT_OFFSET

NODE_COLUMNS = ("nodeid", "isFraud", "init_balance", "fraudStep")
TRANSFER_COLUMNS = ("sourceNodeId", "targetNodeId", "value", "time")


def archive_nodes(nodes: DataFrame) -> DataFrame:
    require_columns(nodes, NODE_COLUMNS, "archive nodes")
    order = F.col(INGEST) if INGEST in nodes.columns else F.monotonically_increasing_id()
    typed = nodes.select(
        whole(number(F.col("nodeid"), -1), -1).alias("node_id"),
        whole(number(F.col("isFraud"))).alias("is_fraud"),
        number(F.col("init_balance")).alias("initial_balance"),
        whole(number(F.col("fraudStep"), -1), -1).alias("fraud_step"),
        order.alias(INGEST),
    )
    return keep_first(typed, ["node_id"], [INGEST]).drop(INGEST)


def archive_transactions(transactions: DataFrame, nodes: DataFrame, *, id_column: str | None = None) -> DataFrame:
    """Rows with all fields present and both endpoints known. Without an id column of its own the
    source gets surrogate ids, which are only ever counted."""
    require_columns(transactions, TRANSFER_COLUMNS, "archive transactions")
    complete = transactions.dropna(subset=list(TRANSFER_COLUMNS))
    identifier = whole(number(F.col(id_column))) if id_column else F.monotonically_increasing_id()
    typed = complete.select(
        whole(number(F.col("sourceNodeId"), -1), -1).alias("source_node_id"),
        whole(number(F.col("targetNodeId"), -1), -1).alias("target_node_id"),
        number(F.col("value")).alias("amount"),
        whole(number(F.col("time"))).alias("event_time"),
        identifier.alias("transaction_id"),
        F.lit(0.0).alias("transaction_type_code"),
    )
    for end in ("source_node_id", "target_node_id"):
        typed = typed.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return typed.select(
        "source_node_id", "target_node_id", "amount", "event_time", "transaction_id", "transaction_type_code"
    )


def pair_totals(transactions: DataFrame, windows: Sequence[int] = ()) -> DataFrame:
    """One row per (source, target): count, amount, first and last time, and per window the count and
    amount of the steps within ``w`` of the latest time of the whole table."""
    latest = transactions.agg(F.max("event_time")).scalar()
    rows = transactions.withColumn("_latest", latest) if windows else transactions
    recent = []
    for w in sorted(set(windows)):
        inside = F.col("event_time") >= F.col("_latest") - w + 1
        recent += [
            F.count_if(inside).alias(f"n_{w}"),
            F.coalesce(money_sum(F.when(inside, F.col("amount"))), F.lit(0)).alias(f"a_{w}"),
        ]
    return rows.groupBy("source_node_id", "target_node_id").agg(
        F.count("*").alias("n"),
        money_sum(F.col("amount")).alias("a"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        *recent,
    )


def _recent_sums(windows: Sequence[int]) -> list[Column]:
    """Per window: transactions, amount, and the number of pairs that were active in it."""
    sums = []
    for w in windows:
        sums += [
            F.sum(f"n_{w}").alias(f"n_{w}"),
            F.sum(f"a_{w}").alias(f"a_{w}"),
            F.count_if(F.col(f"n_{w}") > 0).alias(f"p_{w}"),
        ]
    return sums


def _velocity(column: str, window: int) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) / F.lit(float(max(window, 1)))


def _side(pairs: DataFrame, key: str, side: str, windows: Sequence[int]) -> DataFrame:
    grouped = pairs.groupBy(F.col(key).alias("node_id")).agg(
        F.sum("n").alias("n"),
        F.sum("a").alias("a"),
        F.count("*").alias("pairs"),
        F.min("first_time").alias("first"),
        F.max("last_time").alias("last"),
        *_recent_sums(windows),
    )
    velocities = []
    for w in windows:
        velocities += [
            _velocity(f"n_{w}", w).alias(f"{side}_tx_velocity_{w}d"),
            _velocity(f"a_{w}", w).alias(f"{side}_amount_velocity_{w}d"),
            _velocity(f"p_{w}", w).alias(f"{side}_counterparty_velocity_{w}d"),
        ]
    return grouped.select(
        "node_id",
        F.col("n").alias(f"{side}_transaction_count"),
        F.col("a").cast("double").alias(f"{side}_amount_total"),
        (F.col("a").cast("double") / F.col("n")).alias(f"{side}_amount_mean"),
        F.col("pairs").alias(f"{side}_counterparty_count"),
        F.col("first").alias(f"{side}_first_time"),
        F.col("last").alias(f"{side}_last_time"),
        *velocities,
    )


def flow_names() -> list[str]:
    per_side = [
        f"{side}_{name}"
        for side in ("outgoing", "incoming")
        for name in (
            "transaction_count",
            "amount_total",
            "amount_mean",
            "counterparty_count",
            "first_time",
            "last_time",
        )
    ]
    derived = ["outgoing_time_span", "incoming_time_span", "total_transaction_count", "total_amount"]
    return [*per_side, *derived, "net_outgoing_amount"]


def velocity_names(windows: Sequence[int]) -> list[str]:
    return [
        f"{side}_{what}_velocity_{w}d"
        for w in sorted(set(windows))
        for what in ("tx", "amount", "counterparty")
        for side in ("outgoing", "incoming")
    ]


def account_flows(nodes: DataFrame, pairs: DataFrame, windows: Sequence[int] = ()) -> DataFrame:
    """Flow totals both ways plus, per window, transaction / amount / counterparty velocities."""
    windows = sorted(set(windows))
    joined = (
        nodes.join(_side(pairs, "source_node_id", "outgoing", windows), "node_id", "left")
        .join(_side(pairs, "target_node_id", "incoming", windows), "node_id", "left")
        .fillna(0)
    )
    derived = joined.withColumns(
        {
            "outgoing_time_span": at_least_zero(F.col("outgoing_last_time") - F.col("outgoing_first_time")),
            "incoming_time_span": at_least_zero(F.col("incoming_last_time") - F.col("incoming_first_time")),
            "total_transaction_count": F.col("outgoing_transaction_count") + F.col("incoming_transaction_count"),
            "total_amount": F.col("outgoing_amount_total") + F.col("incoming_amount_total"),
            "net_outgoing_amount": F.col("outgoing_amount_total") - F.col("incoming_amount_total"),
        }
    )
    return derived.select(*nodes.columns, *flow_names(), *velocity_names(windows))


def merchant_bucket(target: Column, seed: int, pool_size: int) -> Column:
    return hash_bucket(target, seed + MERCHANT_OFFSET, pool_size, "merchant")


def archive_merchant_links(transactions: DataFrame, *, seed: int = 17, pool_size: int = 24) -> DataFrame:
    """One merchant per transaction, bucketed from the receiving account."""
    merchant = merchant_bucket(F.col("target_node_id"), seed, pool_size)
    linked = transactions.select(
        "transaction_id", "source_node_id", "target_node_id", "amount", "event_time", merchant.alias("merchant_id")
    )
    return linked.withColumns(
        {
            "merchant_segment": trailing_digits(F.col("merchant_id")).cast("int"),
            "transaction_type_code": segment_code(F.col("merchant_id"), pool_size),
        }
    )


def account_merchant_pairs(
    pairs: DataFrame, windows: Sequence[int] = (), *, seed: int = 17, pool_size: int = 24
) -> DataFrame:
    """(account, merchant) totals. The merchant depends on the target only, so pairs roll up to it."""
    linked = pairs.withColumn("merchant_id", merchant_bucket(F.col("target_node_id"), seed, pool_size))
    recent = [F.sum(f"{m}_{w}").alias(f"{m}_{w}") for w in sorted(set(windows)) for m in ("n", "a")]
    return linked.groupBy("source_node_id", "merchant_id").agg(
        F.sum("n").alias("n"),
        F.sum("a").alias("a"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        *recent,
    )


def merchant_features(
    pairs: DataFrame, windows: Sequence[int] = (), *, seed: int = 17, pool_size: int = 24
) -> DataFrame:
    """Rollup and recency velocities per merchant.

    There are few merchants, so each one is a hot group: both distinct counts are row counts over
    already distinct pairs, and every step below the last is partially aggregated.
    """
    windows = sorted(set(windows))
    buyers = account_merchant_pairs(pairs, windows, seed=seed, pool_size=pool_size)
    totals = buyers.groupBy("merchant_id").agg(
        F.sum("n").alias("transaction_count"),
        F.sum("a").alias("a"),
        F.count("*").alias("unique_buyer_count"),
        F.min("first_time").alias("first_event_time"),
        F.max("last_time").alias("last_event_time"),
        *_recent_sums(windows),
    )
    anchors = (
        pairs.select("target_node_id")
        .distinct()
        .groupBy(merchant_bucket(F.col("target_node_id"), seed, pool_size).alias("merchant_id"))
        .agg(F.count("*").alias("unique_anchor_account_count"))
    )
    velocities = []
    for w in windows:
        velocities += [
            _velocity(f"n_{w}", w).alias(f"merchant_tx_velocity_{w}d"),
            _velocity(f"a_{w}", w).alias(f"merchant_amount_velocity_{w}d"),
            _velocity(f"p_{w}", w).alias(f"merchant_buyer_velocity_{w}d"),
        ]
    amount = F.col("a").cast("double")
    return totals.join(anchors, "merchant_id").select(
        "merchant_id",
        "transaction_count",
        amount.alias("total_amount"),
        (amount / F.col("transaction_count")).alias("average_amount"),
        "unique_buyer_count",
        "unique_anchor_account_count",
        "first_event_time",
        "last_event_time",
        trailing_digits(F.col("merchant_id")).cast("int").alias("merchant_segment"),
        at_least_zero(F.col("last_event_time") - F.col("first_event_time")).alias("active_time_span"),
        *velocities,
    )


def merchant_interactions(features: DataFrame, pairs: DataFrame, *, seed: int = 17, pool_size: int = 24) -> DataFrame:
    """Adds merchant transaction count, amount and distinct merchants to the account features."""
    per_account = (
        account_merchant_pairs(pairs, seed=seed, pool_size=pool_size)
        .groupBy(F.col("source_node_id").alias("node_id"))
        .agg(
            F.sum("n").alias("merchant_transaction_count"),
            F.sum("a").cast("double").alias("merchant_total_amount"),
            F.count("*").alias("unique_merchant_count"),
        )
    )
    added = ["merchant_transaction_count", "merchant_total_amount", "unique_merchant_count"]
    return features.join(per_account, "node_id", "left").fillna(0, subset=added)


