"""Data-quality checks and profiles in long format: one row per check or metric."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import safe_divide
from riskloom.functions.ordered import exact_quantiles
from riskloom.session import materialise

# Keys that must be unique
UNIQUE_KEYS = {
    "accounts.account_id": ("accounts", ["account_id"]),
    "parties.party_id": ("parties", ["party_id"]),
    "transactions.transaction_id_is_cash": ("transactions", ["transaction_id", "is_cash"]),
    "alerts.alert_account": ("alerts", ["alert_id", "account_id"]),
    "banks.bank_id": ("banks", ["bank_id"]),
    "devices.device_id": ("devices", ["device_id"]),
    "ip_addresses.ip_id": ("ip_addresses", ["ip_id"]),
    "merchants.merchant_id": ("merchants", ["merchant_id"]),
}
# Fixed values: (source table, column, target table, column, absent values allowed)
FOREIGN_KEYS = (
    ("accounts", "party_id", "parties", "party_id", False),
    ("accounts", "bank_id", "banks", "bank_id", False),
    ("alerts", "account_id", "accounts", "account_id", False),
    ("alerts", "party_id", "parties", "party_id", False),
    ("transactions", "source_account_id", "accounts", "account_id", False),
    ("transactions", "destination_account_id", "accounts", "account_id", True),
    ("account_device_links", "account_id", "accounts", "account_id", False),
    ("account_device_links", "device_id", "devices", "device_id", False),
    ("account_ip_links", "account_id", "accounts", "account_id", False),
    ("account_ip_links", "ip_id", "ip_addresses", "ip_id", False),
    ("transaction_merchant_links", "transaction_id", "transactions", "transaction_id", False),
    ("transaction_merchant_links", "merchant_id", "merchants", "merchant_id", False),
)
# Columns a table must have
REQUIRED_COLUMNS = {
    "accounts": ["account_id", "party_id", "bank_id", "initial_balance", "is_alerted"],
    "parties": ["party_id", "party_type", "is_alerted"],
    "transactions": ["transaction_id", "source_account_id", "amount", "is_alert_related"],
    "alerts": ["alert_id", "account_id", "party_id"],
}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, n): NULLs per column, and all rows under the name ``*``. One scan per
    table serves both the row counts and the null counts."""

    def one(name: str, df: DataFrame) -> DataFrame:
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
        counted = df.agg(F.count("*").alias("*"), *nulls)
        melted = counted.unpivot([], [F.col("`*`"), *df.columns], "column_name", "n")
        return melted.select(F.lit(name).alias("table_name"), "column_name", "n")

    return union_all([one(name, df) for name, df in tables.items()])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )


def null_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns that contain NULLs."""
    counts = table_counts(tables).where("column_name <> '*' and n > 0")
    return counts.withColumnRenamed("n", "null_count")


def duplicate_counts(tables: dict[str, DataFrame], keys: dict[str, tuple] | None = None) -> DataFrame:
    """Rows beyond the first per key, for all keys in one grouping; NULL counts as a key value."""
    keys = UNIQUE_KEYS if keys is None else keys
    named = [
        tables[t].select(F.lit(name).alias("key_name"), F.array(*[F.col(c).cast("string") for c in columns]).alias("key"))
        for name, (t, columns) in keys.items()
    ]
    sizes = union_all(named).groupBy("key_name", "key").agg(F.count("*").alias("n"))
    beyond = sizes.groupBy("key_name").agg(F.sum(F.col("n") - 1).alias("duplicate_rows"))
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([(name,) for name in keys], "key_name string")
    return every.join(beyond, "key_name", "left").select(
        "key_name", F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return duplicate_counts({name: df}, {name: (name, keys)})


def foreign_key_checks(tables: dict[str, DataFrame], relations: Sequence[tuple] | None = None) -> DataFrame:
    """Rows whose reference has no target, for all relations in one grouping and one join.

    Each source is reduced to value counts per relation first, so a frequent value is one row in the join. The
    targets are distinct (table, column, value) rows.
    """
    relations = FOREIGN_KEYS if relations is None else relations
    spark = next(iter(tables.values())).sparkSession
    names = [f"{source}.{column} -> {target}.{other}" for source, column, target, other, _ in relations]
    described = spark.createDataFrame(
        [(n, f"{r[2]}.{r[3]}", bool(r[4])) for n, r in zip(names, relations)],
        "relation string, target string, allow_absent boolean",
    )
    sources = []
    for source in dict.fromkeys(r[0] for r in relations):
        columns = {n: r[1] for n, r in zip(names, relations) if r[0] == source}
        wide = tables[source].select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("relation"), F.col(f"c{i}").alias("value")) for i, n in enumerate(columns)])
        sources.append(wide.select(F.inline(pairs)))
    values = union_all(sources).groupBy("relation", "value").agg(F.count("*").alias("n"))
    values = values.join(F.broadcast(described), "relation")  # one row per relation
    values = values.where(F.col("value").isNotNull() | ~F.col("allow_absent"))
    targets = [
        tables[t].select(F.lit(f"{t}.{c}").alias("target"), F.col(c).cast("string").alias("value"))
        for t, c in dict.fromkeys((r[2], r[3]) for r in relations)
    ]
    known = union_all(targets).distinct().withColumn("known", F.lit(True))
    checked = values.join(known, ["target", "value"], "left").groupBy("relation")
    checked = checked.agg(
        F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum("n").alias("rows")
    )
    missing = F.coalesce("missing", F.lit(0))
    return described.join(checked, "relation", "left").select(
        "relation",
        (missing == 0).alias("passed"),
        missing.alias("missing_references"),
        F.coalesce("rows", F.lit(0)).alias("checked_rows"),
    )


def foreign_key_check(
    source: DataFrame, column: str, target: DataFrame, target_column: str, *, allow_absent: bool, name: str
) -> DataFrame:
    tables = {"source": source, "target": target}
    checked = foreign_key_checks(tables, [("source", column, "target", target_column, allow_absent)])
    return checked.withColumn("relation", F.lit(name))


def required_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Schema metadata only; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, columns in REQUIRED_COLUMNS.items():
        missing = [c for c in columns if c not in tables[name].columns]
        rows.append((name, not missing, ",".join(missing)))
    return spark.createDataFrame(rows, "table_name string, passed boolean, missing_columns string")


def validation_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every check as (section, check_name, value, passed)."""
    nothing = F.lit(None).cast("boolean")
    is_total = F.col("column_name") == "*"
    counts = (
        table_counts(tables)
        .where(is_total | (F.col("n") > 0))
        .select(
            F.when(is_total, "row_counts").otherwise("null_counts").alias("section"),
            F.when(is_total, F.col("table_name")).otherwise(F.concat_ws(".", "table_name", "column_name")),
            "n",
            nothing,
        )
    )
    unique = duplicate_counts(tables).select(
        F.lit("uniqueness_checks"), "key_name", "duplicate_rows", F.col("duplicate_rows") == 0
    )
    foreign = foreign_key_checks(tables).select(
        F.lit("referential_integrity"), "relation", "missing_references", "passed"
    )
    required = required_columns(tables).select(
        F.lit("required_columns"),
        "table_name",
        F.size(F.filter(F.split("missing_columns", ","), lambda c: c != "")).cast("bigint"),
        "passed",
    )
    checks = reduce(DataFrame.union, [counts, unique, foreign, required])
    return checks.toDF("section", "check_name", "value", "passed")


def verdict(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_checks_passed"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def flag_rate(df: DataFrame, flag: str, name: str) -> DataFrame:
    share = safe_divide(F.count_if(F.col(flag)).cast("double"), F.count("*").cast("double"))
    return df.agg(share.alias("value")).select(F.lit(name).alias("metric"), "value")


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_number(df: DataFrame, column: str, name: str) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles; NULLs are skipped."""
    values = df.select(F.col(column).cast("double").alias("value"))
    basic = values.agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    long = [part.unpivot([], part.columns, "statistic", "value") for part in (basic, exact_quantiles(values, "value", QUARTILES))]
    return union_all(long).where("value is not null").select(F.lit(name).alias("metric"), "statistic", "value")


def top_rows(df: DataFrame, metric: str, key: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(metric), key).limit(k)


def profile_report(tables: dict[str, DataFrame]) -> DataFrame:
    """The profile as (section, item, value)."""
    transactions, accounts = tables["transactions"], tables["accounts"]
    rates = union_all(
        [
            flag_rate(accounts, "is_alerted", "account_alert_rate"),
            flag_rate(tables["parties"], "is_alerted", "party_alert_rate"),
            flag_rate(transactions, "is_alert_related", "transaction_alert_rate"),
            flag_rate(transactions, "is_cash", "cash_transaction_rate"),
        ]
    )
    as_double = F.col("n").cast("double")
    tops = (
        ("top_shared_devices", "devices", "shared_account_count", "device_id"),
        ("top_shared_ip_addresses", "ip_addresses", "shared_account_count", "ip_id"),
        ("top_merchants", "merchants", "transaction_count", "merchant_id"),
    )
    parts = [
        row_counts(tables).select(
            F.lit("table_row_counts").alias("section"),
            F.col("table_name").alias("item"),
            F.col("row_count").cast("double").alias("value"),
        ),
        rates.select(F.lit("rates"), "metric", "value"),
        *[
            value_counts(transactions, c).select(F.lit(f"{c}_distribution"), "value", as_double)
            for c in ("transaction_type", "label_source")
        ],
        *[
            describe_number(df, c, c).select(F.lit(f"{c}_summary"), "statistic", "value")
            for df, c in ((transactions, "amount"), (accounts, "initial_balance"))
        ],
        *[
            top_rows(tables[t], metric, key).select(F.lit(section), key, F.col(metric).cast("double"))
            for section, t, metric, key in tops
        ],
    ]
    return reduce(DataFrame.union, parts)
