"""Batch sources and sinks. Existence checks are file-system metadata; data is read lazily."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from riskloom.operators.canonical import INGEST
from riskloom.schemas import ARCHIVE_DDL, CANONICAL_DDL


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    system, target = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(target))


@dataclass(frozen=True)
class RawLayout:
    """Where the raw tables of a data set are; ``files`` holds the tables that exist."""

    name: str
    base: str
    files: dict[str, str] = field(default_factory=dict)


# File names of the two layouts
SAMPLE_FILES = {
    "accounts": "accounts.csv",
    "transactions": "tx.csv",
    "alerts": "alerts.csv",
    "cash_transactions": "cash_tx.csv",
}
CONVERTED_FILES = {
    "accounts": "accounts.csv",
    "transactions": "transactions.csv",
    "alerts": "alert_accounts.csv",
    "cash_transactions": "cash_tx.csv",
    "alert_transactions": "alert_transactions.csv",
}
LAYOUTS = {
    "sample_outputs": (("sample/outputs", ""), SAMPLE_FILES),
    "converted_outputs": (("outputs", ""), CONVERTED_FILES),
}


def discover_layout(spark: SparkSession, root: str, *, sample_preferred: bool = True) -> RawLayout:
    order = ["sample_outputs", "converted_outputs"]
    for name in order if sample_preferred else reversed(order):
        folders, files = LAYOUTS[name]
        for folder in folders:
            base = f"{root}/{folder}".rstrip("/")
            if all(exists(spark, f"{base}/{files[t]}") for t in ("accounts", "transactions")):
                present = {t: f"{base}/{f}" for t, f in files.items() if exists(spark, f"{base}/{f}")}
                return RawLayout(name, base, present)
    raise FileNotFoundError(f"no raw layout under {root}: expected sample/outputs or outputs files")


def read_text_csv(spark: SparkSession, path: str | None) -> DataFrame | None:
    """All columns as text with their order of arrival; None for an absent table."""
    if path is None or not exists(spark, path):
        return None
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    return raw.withColumn(INGEST, F.monotonically_increasing_id())


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def read_raw_tables(
    spark: SparkSession, root: str, *, sample_preferred: bool = True
) -> tuple[RawLayout, dict[str, DataFrame]]:
    layout = discover_layout(spark, root, sample_preferred=sample_preferred)
    tables = {name: read_text_csv(spark, path) for name, path in layout.files.items()}
    if "alerts" not in tables:
        tables["alerts"] = empty_table(spark, "alert_id string, acct_id string, cust_id string")
    return layout, tables


def write_tables(tables: dict[str, DataFrame], root: str, *, partition_by: Iterable[str] = ()) -> None:
    for name, df in tables.items():
        keys = [k for k in partition_by if k in df.columns]
        df.write.mode("overwrite").partitionBy(*keys).parquet(f"{root}/{name}")


def read_processed_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table under ``root``: Parquet folders, or CSV files with the canonical schema."""
    if not exists(spark, root):
        raise FileNotFoundError(f"no folder of processed tables at {root}")
    tables = {}
    for name in children(spark, root):
        path, stem = f"{root}/{name}", name.removesuffix(".csv").removesuffix(".parquet")
        if name.endswith(".csv"):
            reader = spark.read.option("header", True).option("enforceSchema", False)
            tables[stem] = (reader.schema(CANONICAL_DDL[stem]) if stem in CANONICAL_DDL else reader).csv(path)
        elif not name.startswith(("_", ".")):
            tables[stem] = spark.read.parquet(path)
    return tables


@dataclass(frozen=True)
class ArchiveLayout:
    sample_name: str
    metadata: str
    nodes: str
    transactions: str


def discover_archive(spark: SparkSession, folder: str) -> ArchiveLayout:
    """An unpacked graph archive: metadata.txt, nodes.csv and transactions.csv."""
    folder = folder.rstrip("/")
    members = {n: f"{folder}/{f}" for n, f in (
        ("metadata", "metadata.txt"), ("nodes", "nodes.csv"), ("transactions", "transactions.csv")
    )}
    missing = sorted(path for path in members.values() if not exists(spark, path))
    if missing:
        raise FileNotFoundError(f"{folder} is no graph archive, it lacks {', '.join(missing)}")
    return ArchiveLayout(folder.rsplit("/", 1)[-1], **members)


def read_archive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    layout = discover_archive(spark, folder)
    reader = spark.read.option("header", True)
    return {
        "metadata": archive_metadata(spark.read.text(layout.metadata, wholetext=True)),
        "nodes": reader.schema(ARCHIVE_DDL["nodes"]).csv(layout.nodes),
        "transactions": reader.schema(ARCHIVE_DDL["transactions"]).csv(layout.transactions),
    }


def archive_metadata(text: DataFrame) -> DataFrame:
    """Counts and pattern text reported in a metadata text column ``value``."""

    # The wording of the archive's metadata file
    def reported(pattern: str, group: int):
        digits = F.regexp_replace(F.regexp_extract("value", pattern, group), ",", "")
        return F.nullif(digits, F.lit("")).cast("bigint")

    nodes = r"nodes:\s*([\d,]+)\s*\((\d+) fraud nodes\)"
    return text.select(
        F.trim("value").alias("raw_text"),
        reported(nodes, 1).alias("reported_node_count"),
        reported(nodes, 2).alias("reported_fraud_node_count"),
        reported(r"transactions:\s*([\d,]+)", 1).alias("reported_transaction_count"),
        F.nullif(F.trim(F.regexp_extract("value", r"patterns:[ \t]*(.+)", 1)), F.lit("")).alias("patterns"),
    )


def reconcile_metadata(metadata: DataFrame, nodes: DataFrame, transactions: DataFrame) -> DataFrame:
    """Reported against loaded counts: (quantity, reported, actual, matches)."""
    fraud = F.col("isFraud").try_cast("int") == 1
    actual = {
        "node_count": nodes.agg(F.count("*")).scalar(),
        "fraud_node_count": nodes.agg(F.count_if(fraud)).scalar(),
        "transaction_count": transactions.agg(F.count("*")).scalar(),
    }
    counted = metadata.withColumns({f"actual_{n}": c for n, c in actual.items()})
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("quantity"),
                F.col(f"reported_{n}").alias("reported"),
                F.col(f"actual_{n}").alias("actual"),
            )
            for n in actual
        ]
    )
    rows = counted.select(F.explode(pairs).alias("c")).select("c.*")
    return rows.withColumn("matches", F.col("reported").eqNullSafe(F.col("actual")))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """One JSON folder per report: validation, profile, drift, activity, graph summary, metrics or any other set."""
    for name, report in reports.items():
        write_report(report, f"{root}/{name}")


def read_report(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """A report by the schema it was written with: JSON itself has no integers, and drops NULL fields."""
    return spark.read.schema(schema).json(f"{root}/{name}")


def write_features(features: DataFrame, path: str, *, as_csv: bool = False) -> None:
    writer = features.write.mode("overwrite")
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)
