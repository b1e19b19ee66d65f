import pytest
from pyspark.sql import functions as F

from riskloom.operators import canonical as canon, enrich, features, quality
from riskloom.plans.canonical import canonical_tables
from riskloom.plans.data import WINDOWS
from riskloom.session import work_path
from riskloom.sources import files


@pytest.fixture(scope="module")
def raw(spark):
    accounts = spark.createDataFrame(
        [
            ("10", "P1", "US", "100.5", "3.9", "yes", 0),
            ("2", "P1", "DE", "n/a", None, "1.0", 1),
            ("3", " ", "US", None, "7", "true", 2),
            ("10", "P9", "FR", "1", "1", "no", 3),
        ],
        "acct_id string, cust_id string, country string, init_balance string, start string, suspicious string, _ingest_order long",
    )
    alerts = spark.createDataFrame(
        [("A1", "2", "", "t1"), ("A2", "2", "P1", "t2"), ("A3", "3", "nobody", "t1"), ("A3", "3", "nobody", "t1"),
         ("A4", "99", None, None)],
        "alert_id string, acct_id string, cust_id string, alert_type string",
    )
    transfers = spark.createDataFrame(
        [("1", "10", "2", "5.5", "1", 0), ("2", "10", "77", "x", "2", 1), ("1", "3", "3", "9", "9", 2),
         ("4", "99", "10", "1", "3", 3), ("5", "10", "10", "2", "4", 4)],
        "tran_id string, orig_acct string, bene_acct string, base_amt string, start string, _ingest_order long",
    )
    cash = spark.createDataFrame(
        [("1", "10", "3.25", "6", "8", 0)],
        "tran_id string, orig_acct string, base_amt string, start string, RUN_DATE string, _ingest_order long",
    )
    direct = spark.createDataFrame([("2",), ("1",)], "tran_id string")
    return {
        "accounts": accounts, "alerts": alerts, "transactions": transfers, "cash_transactions": cash,
        "alert_transactions": direct,
    }


@pytest.fixture(scope="module")
def tables(raw):
    return canonical_tables(raw, "test")


def test_accounts(tables):
    got = {r.account_id: r for r in tables["accounts"].collect()}
    assert set(got) == {"10", "2", "3"}
    assert (got["10"].party_id, got["10"].initial_balance, got["10"].start_step) == ("P1", 100.5, 3)
    assert (got["2"].initial_balance, got["2"].source_suspicious_flag, got["2"].alert_count) == (0.0, False, 2)
    # duplicate raw alert rows count, and a blank owner falls back to the account
    assert (got["3"].party_id, got["3"].alert_count, got["3"].is_alerted) == ("party_3", 2, True)
    assert got["10"].bank_id == "bank_default" and not got["10"].is_alerted


def test_alerts_and_parties(tables):
    alerts = {(r.alert_id, r.account_id, r.party_id) for r in tables["alerts"].collect()}
    assert alerts == {("A1", "2", "P1"), ("A2", "2", "P1"), ("A3", "3", "party_3"), ("A4", "99", None)}
    assert tables["alerts"].count() == 4
    parties = {r.party_id: r for r in tables["parties"].collect()}
    # two countries: the one of the numerically smallest account
    assert (parties["P1"].country_code, parties["P1"].account_count, parties["P1"].alert_count) == ("DE", 2, 2)


def test_transactions(tables):
    got = {(r.transaction_id, r.is_cash): r for r in tables["transactions"].collect()}
    assert set(got) == {("1", False), ("2", False), ("4", False), ("5", False), ("1", True)}
    assert got[("1", False)].label_source == "direct_alert_transaction"
    assert got[("1", False)].source_account_id == "10"
    assert (got[("2", False)].amount, got[("2", False)].destination_party_id) == (0.0, None)
    # alerted id without an account row still marks the transaction
    assert (got[("4", False)].label_source, got[("4", False)].source_party_id) == ("alert_adjacent_account", None)
    assert (got[("5", False)].label_source, got[("5", False)].is_alert_related) == ("none", False)
    cash = got[("1", True)]
    assert (cash.destination_account_id, cash.transaction_type, cash.event_step) == (None, "CASH", 8)


def test_quality_finds_the_broken_references(tables):
    checks = {r.relation: (r.missing_references, r.checked_rows) for r in quality.foreign_key_checks(tables).collect()}
    assert checks["transactions.destination_account_id -> accounts.account_id"] == (1, 4)
    assert checks["transactions.source_account_id -> accounts.account_id"] == (1, 5)
    assert checks["alerts.party_id -> parties.party_id"] == (1, 4)
    assert quality.verdict(quality.validation_report(tables)).first()[0] is False
    dup = quality.duplicate_count(tables["transactions"], ["transaction_id"], "t").first()
    assert dup.duplicate_rows == 1


def test_feature_tables(tables):
    rows = features.transaction_features(tables, windows=WINDOWS)
    assert len(rows.columns) == 50 and rows.count() == 5
    cash = rows.where("is_cash").first()
    # rows without a destination get no pooled incoming totals
    assert (cash.incoming_transaction_count, cash.destination_account_previous_gap) == (0, 0.0)
    parties = features.party_features(tables, windows=WINDOWS)
    assert len(parties.columns) == 34 and parties.count() == 2


def test_shared_count_is_one_row_per_id(spark):
    links = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "account_id string, device_id string")
    got = {tuple(r) for r in features.shared_count(links, "device_id", "account_id", "n").collect()}
    assert got == {("a", 2), ("b", 2), ("c", 1)}


def test_pools_must_be_positive(tables):
    from riskloom.settings import Enrichment

    with pytest.raises(ValueError):
        enrich.device_links(tables["accounts"], Enrichment(device_pool_size=0))


def test_layouts(spark, raw):
    root = work_path(spark, "raw")
    write = lambda df, path: df.drop(canon.INGEST).write.option("header", True).csv(f"{root}/{path}")
    with pytest.raises(FileNotFoundError):
        files.discover_layout(spark, root)
    write(raw["accounts"], "outputs/accounts.csv")
    write(raw["transactions"], "outputs/transactions.csv")
    layout, found = files.read_raw_tables(spark, root)
    assert layout.name == "converted_outputs" and found["alerts"].count() == 0
    write(raw["accounts"], "sample/outputs/accounts.csv")
    write(raw["transactions"], "sample/outputs/tx.csv")
    assert files.discover_layout(spark, root).name == "sample_outputs"
    assert files.discover_layout(spark, root, sample_preferred=False).name == "converted_outputs"
    assert canonical_tables(found, layout.name)["accounts"].where("is_alerted").count() == 0


def test_bundle_round_trip(spark, tables):
    root = work_path(spark, "bundle")
    files.write_tables(tables, root)
    loaded = files.read_processed_tables(spark, root)
    assert set(loaded) == set(tables)
    assert loaded["transactions"].exceptAll(tables["transactions"]).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_processed_tables(spark, root + "-none")


def test_archive_source(spark):
    root = work_path(spark, "sample")
    with pytest.raises(FileNotFoundError, match="metadata.txt.*nodes.csv"):
        files.discover_archive(spark, root)
    text = "nodes: 1,003 (12 fraud nodes)\ntransactions: 20,558\npatterns: fan_in, cycle"
    row = files.archive_metadata(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.reported_node_count, row.reported_fraud_node_count, row.reported_transaction_count) == (1003, 12, 20558)
    assert row.patterns == "fan_in, cycle"
    blank = files.archive_metadata(spark.createDataFrame([("none",)], "value string")).first()
    assert blank.reported_node_count is None and blank.patterns is None
    nodes = spark.createDataFrame([("1", "1"), ("2", "0")], "nodeid string, isFraud string")
    transfers = spark.range(3)
    meta = files.archive_metadata(
        spark.createDataFrame([("nodes: 2 (1 fraud nodes)\ntransactions: 4",)], "value string")
    )
    checks = {r.quantity: r.matches for r in files.reconcile_metadata(meta, nodes, transfers).collect()}
    assert checks == {"node_count": True, "fraud_node_count": True, "transaction_count": False}
    assert nodes.where(F.col("isFraud") == "1").count() == 1


def test_tables_are_built_when_asked_for(raw):
    """A job that reads accounts does not pay for transactions; the eleven names are all there."""
    tables = canonical_tables({n: df for n, df in raw.items() if n in ("accounts", "alerts")}, "test")
    assert len(tables) == 11 and "transactions" in tables
    assert tables["accounts"].count() > 0 and tables["ip_addresses"].count() > 0
    with pytest.raises(KeyError):
        tables["transactions"]
