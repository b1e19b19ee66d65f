"""Canonical table schemas. Ids are text: reading them as numbers would lose blanks and zeros."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical columns
CANONICAL_DDL = {
    "accounts": "account_id string, party_id string, bank_id string, country_code string, business_type string, "
    "initial_balance double, start_step bigint, end_step bigint, source_suspicious_flag boolean, model_id bigint, "
    "layout_name string, source_type string, is_alerted boolean, alert_count bigint",
    "parties": "party_id string, country_code string, layout_name string, party_type string, source_type string, "
    "account_count bigint, is_alerted boolean, alert_count bigint",
    "transactions": "transaction_id string, source_account_id string, destination_account_id string, "
    "transaction_type string, amount double, event_step bigint, event_timestamp string, is_cash boolean, "
    "layout_name string, source_party_id string, destination_party_id string, is_alert_related boolean, "
    "label_source string, source_type string",
    "alerts": "alert_id string, alert_type string, account_id string, party_id string, event_value string, "
    "is_sar boolean, layout_name string",
    "banks": "bank_id string, country_hint string, source_type string",
    "devices": "device_id string, shared_account_count bigint, source_type string, device_family string",
    "ip_addresses": "ip_id string, shared_account_count bigint, country_hint string, source_type string",
    "merchants": "merchant_id string, transaction_count bigint, source_type string, merchant_segment string",
    "account_device_links": "account_id string, device_id string",
    "account_ip_links": "account_id string, country_code string, ip_id string",
    "transaction_merchant_links": "transaction_id string, merchant_id string",
}

ARCHIVE_DDL = {
    "nodes": "nodeid string, isFraud string, init_balance string, fraudStep string",
    "transactions": "sourceNodeId string, targetNodeId string, value string, time string",
}


def canonical_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(CANONICAL_DDL[table])
