"""Raw risk tables projected from the order, customer and event tables of a data directory.

The projection yields the raw column names and the dirt (blank owners, unparsable numbers, unknown
parties) that canonicalisation has to handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.operators.canonical import INGEST

LAYOUT = "converted_outputs"
EPOCH = "1995-01-01"
DIRECT_ALERT_AMOUNT = 450000.0


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def raw_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    customer = table(spark, directory, "customer")
    orders = table(spark, directory, "orders")
    nation = table(spark, directory, "nation")
    region = table(spark, directory, "region")
    key = F.col("c_custkey")
    text_key = key.cast("string")

    countries = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("c_nationkey"), "r_name"
    )
    accounts = customer.join(countries, "c_nationkey", "left").select(
        text_key.alias("acct_id"),
        F.when(F.col("c_nationkey") == 0, "")
        .otherwise(F.concat(F.lit("P_"), F.floor(key / 2).cast("string")))
        .alias("cust_id"),
        F.concat(F.lit("bank_"), F.col("c_nationkey").cast("string")).alias("bank_id"),
        F.col("r_name").alias("country"),
        F.col("c_mktsegment").alias("business"),
        F.col("c_acctbal").cast("string").alias("init_balance"),
        F.col("c_nationkey").cast("string").alias("start"),
        F.when(F.col("c_mktsegment") == "BUILDING", "n/a")
        .otherwise((F.col("c_nationkey") * 10 + 0.5).cast("string"))
        .alias("end"),
        F.when(F.col("c_acctbal") < -500, " Yes ")
        .when(F.col("c_acctbal") > 9000, "1.0")
        .otherwise("false")
        .alias("suspicious"),
        (F.col("c_nationkey") % 5).cast("string").alias("modelID"),
        key.alias(INGEST),
    )
    alerts = customer.where(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("AL"), text_key).alias("alert_id"),
        F.col("c_mktsegment").alias("alert_type"),
        text_key.alias("acct_id"),
        F.when(key % 2 == 0, "").otherwise("unknown_party").alias("cust_id"),
        F.col("c_nationkey").cast("string").alias("start"),
        F.when(F.col("c_acctbal") < -500, "true").otherwise("no").alias("is_sar"),
    )
    accounts_total = customer.agg(F.count("*")).scalar()
    sized = orders.withColumn("_n", accounts_total)
    folded = F.col("o_orderkey") % F.col("_n")
    target = F.pmod(folded * folded + F.col("o_custkey"), F.col("_n"))
    order_day = F.to_date("o_orderdate")
    days = F.datediff(order_day, F.lit(EPOCH).cast("date"))
    common = [
        F.col("o_orderkey").cast("string").alias("tran_id"),
        F.col("o_custkey").cast("string").alias("orig_acct"),
        F.col("o_orderpriority").alias("tx_type"),
        F.col("o_totalprice").cast("string").alias("base_amt"),
        (F.floor(days / 7) + 1).cast("string").alias("start"),
        order_day.cast("string").alias("tran_timestamp"),
        F.col("o_orderkey").alias(INGEST),
    ]
    is_cash = F.col("o_orderstatus") == "P"
    return {
        "accounts": accounts,
        "alerts": alerts,
        "transactions": sized.where(~is_cash).select(*common, target.cast("string").alias("bene_acct")),
        "cash_transactions": orders.where(is_cash).select(*common),
        "alert_transactions": orders.where(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= DIRECT_ALERT_AMOUNT)
        ).select(F.col("o_orderkey").cast("string").alias("tran_id")),
    }


def event_stream(events: DataFrame) -> DataFrame:
    """Dense per-user series: step = day of the month-long log."""
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").cast("string").alias("source_account_id"),
        F.dayofmonth("ts").cast("bigint").alias("event_step"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("transaction_type"),
    )


def archive_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Raw graph inputs: every account as a node, every transfer between accounts as an edge row."""
    raw = raw_tables(spark, directory)
    customer = table(spark, directory, "customer")
    alerted = F.col("c_acctbal") < 0
    nodes = customer.select(
        F.col("c_custkey").cast("string").alias("nodeid"),
        alerted.cast("int").cast("string").alias("isFraud"),
        F.col("c_acctbal").cast("string").alias("init_balance"),
        F.when(alerted, F.col("c_nationkey").cast("string")).alias("fraudStep"),
    )
    transactions = raw["transactions"].select(
        F.col("orig_acct").alias("sourceNodeId"),
        F.col("bene_acct").alias("targetNodeId"),
        F.col("base_amt").alias("value"),
        F.col("start").alias("time"),
        F.col("tran_id").alias("id"),
    )
    return {"nodes": nodes, "transactions": transactions}
