"""Deterministic device, address and merchant links derived by seeded hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import hash_bucket, trailing_digits
from riskloom.settings import Enrichment

# Offsets added to the enrichment seed
DEVICE_ALERT_OFFSET = 100
ADDRESS_ALERT_OFFSET = 200
MERCHANT_OFFSET = 300


def _risk_bucket(seed: int, offset: int, pool: int, alerted_pool: int, prefix: str):
    alerted = F.col("is_alerted")
    if min(pool, alerted_pool) <= 0:
        raise ValueError("a pool needs at least one bucket")
    return hash_bucket(
        F.col("account_id"),
        F.when(alerted, seed + offset).otherwise(seed),
        F.when(alerted, alerted_pool).otherwise(pool),
        prefix,
    )


def device_links(accounts: DataFrame, settings: Enrichment = Enrichment()) -> DataFrame:
    """Alerted accounts share a small device pool, all others the large one."""
    bucket = _risk_bucket(
        settings.seed,
        DEVICE_ALERT_OFFSET,
        settings.device_pool_size,
        settings.suspicious_device_pool_size,
        "device",
    )
    return accounts.select("account_id", bucket.alias("device_id"))


def devices(links: DataFrame) -> DataFrame:
    return (
        links.groupBy("device_id")
        .agg(F.countDistinct("account_id").alias("shared_account_count"))
        .withColumns({"source_type": F.lit("derived"), "device_family": trailing_digits(F.col("device_id"))})
    )


def address_links(accounts: DataFrame, settings: Enrichment = Enrichment()) -> DataFrame:
    bucket = _risk_bucket(
        settings.seed, ADDRESS_ALERT_OFFSET, settings.ip_pool_size, settings.suspicious_ip_pool_size, "ip"
    )
    return accounts.select("account_id", "country_code", bucket.alias("ip_id"))


def addresses(links: DataFrame) -> DataFrame:
    return (
        links.groupBy("ip_id")
        .agg(F.countDistinct("account_id").alias("shared_account_count"))
        .withColumns({"country_hint": F.lit("US"), "source_type": F.lit("derived")})
    )


def merchant_links(transactions: DataFrame, settings: Enrichment = Enrichment()) -> DataFrame:
    """The anchor is the receiving account, or the sending one for cash."""
    anchor = F.coalesce("destination_account_id", "source_account_id", F.lit(""))
    bucket = hash_bucket(
        F.concat_ws(":", anchor, F.col("transaction_type")),
        settings.seed + MERCHANT_OFFSET,
        settings.merchant_pool_size,
        "merchant",
    )
    return transactions.select("transaction_id", bucket.alias("merchant_id"))


def merchants(links: DataFrame) -> DataFrame:
    return (
        links.groupBy("merchant_id")
        .agg(F.countDistinct("transaction_id").alias("transaction_count"))
        .withColumns({"source_type": F.lit("derived"), "merchant_segment": trailing_digits(F.col("merchant_id"))})
    )
