"""Transaction and party feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import left_lookup, money_sum, with_prefix
from riskloom.operators import trailing
from riskloom.settings import checked_windows


def outgoing_profile(transactions: DataFrame, key: str, distinct_name: str = "unique_destinations") -> DataFrame:
    return _profile(transactions, key, "destination_account_id", "outgoing", distinct_name)


def incoming_profile(transactions: DataFrame, key: str, distinct_name: str = "unique_sources") -> DataFrame:
    return _profile(transactions, key, "source_account_id", "incoming", distinct_name)


def _profile(transactions: DataFrame, key: str, counterparty: str, side: str, distinct_name: str) -> DataFrame:
    # the single distinct count is planned as two partial steps, the first hashed by (key, counterparty)
    return (
        transactions.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias(f"{side}_transaction_count"),
            money_sum(F.col("amount")).cast("double").alias(f"{side}_amount_total"),
            F.countDistinct(counterparty).alias(distinct_name),
        )
    )


def shared_count(links: DataFrame, entity: str, id_column: str, name: str) -> DataFrame:
    """Per id, how many ids share its entity (device, address); one row per id."""
    sizes = links.groupBy(entity).agg(F.countDistinct(id_column).alias(name))
    return links.join(sizes, entity, "left").groupBy(id_column).agg(F.max(name).alias(name))


def links_per_party(links: DataFrame, accounts: DataFrame, entity: str, name: str) -> DataFrame:
    owned = links.join(accounts.select("account_id", "party_id"), "account_id", "left")
    return owned.where("party_id is not null").groupBy("party_id").agg(F.countDistinct(entity).alias(name))


def account_attributes(tables: dict[str, DataFrame]) -> DataFrame:
    devices = shared_count(tables["account_device_links"], "device_id", "account_id", "shared_device_count")
    addresses = shared_count(tables["account_ip_links"], "ip_id", "account_id", "shared_ip_count")
    attributes = tables["accounts"].select("account_id", "initial_balance", "is_alerted")
    joined = attributes.join(devices, "account_id", "left").join(addresses, "account_id", "left")
    return joined.fillna(0, subset=["shared_device_count", "shared_ip_count"])


ATTRIBUTES = ("initial_balance", "is_alerted", "shared_device_count", "shared_ip_count")
OUTGOING = ("outgoing_transaction_count", "outgoing_amount_total", "unique_destinations")
INCOMING = ("incoming_transaction_count", "incoming_amount_total", "unique_sources")


def transaction_feature_names(windows: Sequence[int]) -> list[str]:
    return [
        "transaction_id",
        "source_account_id",
        "destination_account_id",
        "transaction_type",
        "amount",
        "event_step",
        "is_cash",
        *OUTGOING,
        *INCOMING,
        *[f"source_{a}" for a in ATTRIBUTES],
        *[f"destination_{a}" for a in ATTRIBUTES],
        *[n for _, prefix in trailing.ENTITY_ROLES for n in trailing.feature_names(prefix, windows)],
        "label",
        "label_source",
    ]


def transaction_features(tables: dict[str, DataFrame], *, windows: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """50 columns per transaction at the default windows.

    Profile and attributes of an account are merged before they meet the transactions, so the fact
    table joins once per role.
    """
    windows = checked_windows(windows)
    transactions = tables["transactions"]
    attributes = account_attributes(tables)
    source = (
        with_prefix(attributes, "source_")
        .join(outgoing_profile(transactions, "source_account_id"), "source_account_id", "full_outer")
    )
    destination = (
        with_prefix(attributes, "destination_")
        .join(incoming_profile(transactions, "destination_account_id"), "destination_account_id", "full_outer")
    )
    rows = trailing.transaction_history(transactions, windows=windows)
    identity = ["transaction_id", "event_step", "amount"]
    joined = left_lookup(rows, source, "source_account_id", identity)
    joined = left_lookup(joined, destination, "destination_account_id", identity)
    numbers = [*OUTGOING, *INCOMING, *[f"{r}_{a}" for r in ("source", "destination") for a in ATTRIBUTES]]
    flags = [n for n in numbers if n.endswith("is_alerted")]
    filled = joined.fillna(0, subset=[n for n in numbers if n not in flags]).fillna(False, subset=flags)
    labelled = filled.withColumn("label", F.col("is_alert_related").cast("int"))
    return labelled.select(transaction_feature_names(windows))


def party_feature_names(windows: Sequence[int]) -> list[str]:
    return [
        "party_id",
        "party_type",
        "country_code",
        "account_count",
        "alert_count",
        "outgoing_transaction_count",
        "outgoing_amount_total",
        "unique_destination_accounts",
        "incoming_transaction_count",
        "incoming_amount_total",
        "unique_source_accounts",
        "device_count",
        "ip_count",
        *trailing.party_activity_names(windows),
        "label",
    ]


def party_features(tables: dict[str, DataFrame], *, windows: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """34 columns per party at the default windows."""
    windows = checked_windows(windows)
    transactions, accounts = tables["transactions"], tables["accounts"]

    def keyed(profile: DataFrame, key: str) -> DataFrame:
        return profile.withColumnRenamed(key, "party_id")

    parts = [
        keyed(outgoing_profile(transactions, "source_party_id", "unique_destination_accounts"), "source_party_id"),
        keyed(incoming_profile(transactions, "destination_party_id", "unique_source_accounts"), "destination_party_id"),
        links_per_party(tables["account_device_links"], accounts, "device_id", "device_count"),
        links_per_party(tables["account_ip_links"], accounts, "ip_id", "ip_count"),
        trailing.party_activity(transactions, tables["parties"], windows=windows),
    ]
    joined = tables["parties"]
    for part in parts:
        joined = joined.join(part, "party_id", "left")
    labelled = joined.fillna(0).withColumn("label", F.col("is_alerted").cast("int"))
    return labelled.select(party_feature_names(windows))


def feature_sets(tables: dict[str, DataFrame], *, windows: Sequence[int] = (1, 7, 30)) -> dict[str, DataFrame]:
    """Both feature tables of the canonical tables: ``transaction`` and ``party``."""
    return {
        "transaction": transaction_features(tables, windows=windows),
        "party": party_features(tables, windows=windows),
    }
