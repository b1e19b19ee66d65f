import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drift


def ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


def test_statistic_and_means_match_brute_force(spark):
    rng = random.Random(7)
    rows = [
        (cohort, float(rng.choice([0, 0, 0, 1, 2])), rng.gauss(shift, 1))
        for cohort, shift, n in (("baseline", 0, 300), ("recent", 0.4, 130))
        for _ in range(n)
    ]
    rows += [(None, 9.0, 9.0), ("recent", None, 1.0)]
    df = spark.createDataFrame(rows, "cohort string, zeros double, noise double")
    got = {r.feature: r for r in drift.feature_drift(df, ["zeros", "noise"]).collect()}
    for i, name in ((1, "zeros"), (2, "noise")):
        a = [r[i] for r in rows if r[0] == "baseline"]
        b = [r[i] for r in rows if r[0] == "recent" and r[i] is not None]
        assert got[name].ks_statistic == pytest.approx(ks(a, b), abs=1e-12)
        assert got[name].baseline_mean == pytest.approx(sum(a) / len(a))
        assert got[name].recent_mean == pytest.approx(sum(b) / len(b))


def test_statistic_is_symmetric(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["baseline", "recent"]), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "cohort string, x double")
    swapped = df.withColumn("cohort", F.when(F.col("cohort") == "recent", "baseline").otherwise("recent"))
    one, two = (drift.feature_drift(d, ["x"]).first().ks_statistic for d in (df, swapped))
    assert one == pytest.approx(two) and 0 <= one <= 1


def test_pvalue_by_enumeration():
    # all ways to interleave 5 + 3 values
    n, m = 5, 3
    seen = {}
    for places in itertools.combinations(range(n + m), m):
        i = j = 0
        worst = 0.0
        for s in range(n + m):
            i, j = (i, j + 1) if s in places else (i + 1, j)
            worst = max(worst, abs(i / n - j / m))
        seen[round(worst, 9)] = seen.get(round(worst, 9), 0) + 1
    total = sum(seen.values())
    for d in seen:
        assert drift.exact_ks_pvalue(d, n, m) == pytest.approx(sum(c for e, c in seen.items() if e >= d) / total)


def asymptotic(spark, rows):
    df = spark.createDataFrame(rows, "ks_statistic double, baseline_rows long, recent_rows long")
    return [r.ks_pvalue for r in drift.with_pvalue(df).collect()]


def test_exact_pvalue(spark):
    assert drift.exact_ks_pvalue(0.0, 10, 10) == 1.0
    # a published pair of sizes and statistic
    assert drift.exact_ks_pvalue(0.525, 80, 15) == pytest.approx(0.00098980620077, rel=1e-9)
    df = spark.createDataFrame([(0.525, 80, 15)], "ks_statistic double, baseline_rows long, recent_rows long")
    assert drift.with_pvalue(df, method="exact").first().ks_pvalue == pytest.approx(0.00098980620077, rel=1e-9)
    with pytest.raises(ValueError, match="method"):
        drift.with_pvalue(df, method="both")


def test_asymptotic_pvalue(spark):
    assert asymptotic(spark, [(1e-6, 10**7, 10**7), (1e-5, 10**6, 10**6), (0.0, 5, 5)]) == [1.0, 1.0, 1.0]
    rows = [(0.02, 10_000, 9_000), (0.03, 2000, 3000), (0.05, 2000, 3000), (0.2, 60, 90), (0.3, 100, 100)]
    for p, row in zip(asymptotic(spark, rows), rows):
        assert p == pytest.approx(drift.exact_ks_pvalue(*row), rel=0.12, abs=2e-3)
    falling = asymptotic(spark, [(i / 1000, 1000, 1000) for i in range(1, 200)])
    assert all(a >= b for a, b in zip(falling, falling[1:])) and falling[-1] < 1e-15
    assert asymptotic(spark, [(1.0, 10**12, 10**12)]) == [0.0]


def test_cohorts_and_fallback(spark):
    dense = spark.createDataFrame([(s,) for s in range(1, 51)], "event_step bigint")
    row = drift.cohort_summary(dense).first()
    assert (row.baseline_start, row.baseline_end, row.recent_start) == (14, 43, 44)
    assert (row.baseline_rows, row.recent_rows) == (30, 7)
    # no row in the 30 steps before: every earlier row is the baseline
    gap = spark.createDataFrame([(1,), (2,), (100,)], "event_step bigint")
    assert tuple(drift.cohort_summary(gap).first())[-2:] == (2, 1)
    short = spark.createDataFrame([(5,), (6,), (9,)], "event_step bigint")
    row = drift.cohort_summary(short, recent_window=1).first()
    assert (row.baseline_start, row.baseline_rows, row.recent_rows) == (5, 2, 1)


def test_shifted_features_are_flagged(spark):
    rows = [(0.5 + 0.05 * i, 100.0 + 10 * i, 1.0) for i in range(20)]
    base = spark.createDataFrame(rows, "outgoing_tx_velocity_30d double, total_amount double, other double")
    surged = drift.perturbed(base, ["outgoing_tx_velocity_30d", "total_amount"], 5.0)
    report = drift.distribution_drift(base, surged)
    flags = {r.feature: r.drifted for r in report.collect()}
    assert flags == {"outgoing_tx_velocity_30d": True, "total_amount": True, "other": False}
    verdict = drift.drift_verdict(report).first()
    assert verdict.drift_detected and verdict.drift_score >= 0.2
    assert verdict.drifted_features == ["outgoing_tx_velocity_30d", "total_amount"]
    assert (verdict.baseline_rows, verdict.recent_rows, verdict.feature_count_analyzed) == (20, 20, 3)


def test_distribution_drift_rejects_unusable_input(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, t string")
    with pytest.raises(ValueError, match="Baseline"):
        drift.distribution_drift(df.limit(0), df)
    with pytest.raises(ValueError, match="Recent"):
        drift.distribution_drift(df, df.limit(0))
    with pytest.raises(ValueError, match="overlapping"):
        drift.distribution_drift(df, df, columns=["t"])
    with pytest.raises(KeyError):
        drift.perturbed(df, ["nope"], 2.0)


def test_column_selection(spark):
    df = spark.createDataFrame([], "node_id long, a_prev_1 double, gap int, name_gap string, flag boolean, other float")
    assert drift.temporal_feature_columns(df) == ["a_prev_1", "gap", "name_gap"]
    assert drift.distribution_feature_columns(df) == ["a_prev_1", "gap", "flag", "other"]


def test_activity(spark):
    rows = [("1", 1, 5.0, True, False), ("2", 1, 2.0, False, True), ("3", 8, 1.5, True, True)]
    df = spark.createDataFrame(
        rows, "transaction_id string, event_step long, amount double, is_alert_related boolean, is_cash boolean"
    )
    steps = {r.event_step: r for r in drift.activity_by_step(df).collect()}
    assert (steps[1].amount_total, steps[1].alert_related_rate, steps[8].cash_rate) == (7.0, 0.5, 1.0)
    card = drift.recent_scorecard(df, (1, 7, 30)).first()
    assert (card.transactions_recent_7, card.amount_recent_30, card.alert_related_recent_30) == (1, 8.5, 2)


def whole_lattice(statistic, n, m):
    """The same chance with all cells of every diagonal."""
    scale = math.lcm(n, m)
    edge, stay = round(statistic * scale), {(0, 0): 1.0}
    for s in range(1, n + m + 1):
        ahead = {}
        for (i, j), p in stay.items():
            left = n + m - s + 1
            for a, b, chance in ((i + 1, j, (n - i) / left), (i, j + 1, (m - j) / left)):
                if chance > 0 and abs(a * (scale // n) - b * (scale // m)) < edge:
                    ahead[a, b] = ahead.get((a, b), 0.0) + p * chance
        stay = ahead
    return 1.0 - stay.get((n, m), 0.0)


def test_exact_pvalue_of_small_cases():
    random = np.random.default_rng(4)
    for _ in range(200):
        n, m = (int(x) for x in random.integers(1, 25, 2))
        scale = math.lcm(n, m)
        statistic = int(random.integers(1, scale + 1)) / scale
        assert drift.exact_ks_pvalue(statistic, n, m) == pytest.approx(whole_lattice(statistic, n, m), abs=1e-10)


def test_exact_pvalue_at_size():
    started = time.perf_counter()
    p = drift.exact_ks_pvalue(0.02, 10_000, 10_000)
    assert time.perf_counter() - started < 3
    # reflections of the paths that leave the band, of two samples of one size
    n, h = 10_000, 200
    ratio = [math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - k * h + 1) - math.lgamma(n + k * h + 1)) for k in range(1, 51)]
    assert p == pytest.approx(2 * sum((-1) ** k * r for k, r in enumerate(ratio)), rel=1e-6)


def test_small_samples_are_exact_by_default(spark, monkeypatch):
    rows = spark.createDataFrame([("f", 0.3, 40, 20)], "feature string, ks_statistic double, baseline_rows long, recent_rows long")
    exact = drift.exact_ks_pvalue(0.3, 40, 20)
    assert drift.with_pvalue(rows, method="auto").first().ks_pvalue == pytest.approx(exact)
    monkeypatch.setattr(drift, "EXACT_ROWS", 30)
    found = drift.with_pvalue(rows, method="auto").first().ks_pvalue
    assert found == drift.with_pvalue(rows).first().ks_pvalue and found != pytest.approx(exact, rel=1e-6)


def test_exact_pvalue_of_equal_sizes():
    """Samples of one size take a series instead of a walk over all their rows."""
    for n, statistic in ((1, 1.0), (5, 0.2), (7, 3 / 7), (40, 0.3), (60, 0.05)):
        assert drift.exact_ks_pvalue(statistic, n, n) == pytest.approx(whole_lattice(statistic, n, n), abs=1e-10)
    started = time.perf_counter()
    assert drift.exact_ks_pvalue(0.001, 1_500_000, 1_500_000) == pytest.approx(2 * math.exp(-2 * 0.001**2 * 750_000), abs=0.02)
    assert time.perf_counter() - started < 2


def test_activity_summary_stores_no_feature_table(spark, monkeypatch):
    from riskloom.plans import data as plans_data, queries_features  # noqa: F401
    from riskloom.plans.registry import QUERIES

    transactions = spark.createDataFrame([(1, 5.0, True, False)], "event_step long, amount double, is_alert_related boolean, is_cash boolean")
    velocity = spark.createDataFrame(
        [(f"T{i}", "A", i / 16, 1.0, i % 2, 9.0) for i in range(12)],
        "transaction_id string, source_account_id string, source_account_velocity_ratio_1_to_30 double,"
        " source_account_count_prev_7 double, label int, unused double",
    )
    parties = spark.createDataFrame(
        [("P1", 2, 3.0, 0), ("P2", 4, 1.0, 1)],
        "party_id string, outgoing_count_recent_30 long, outgoing_amount_recent_30 double, label int",
    )
    opened = plans_data.RiskData(spark, "own rows")
    opened.__dict__.update(
        tables={"transactions": transactions, "parties": parties}, feature_sets={"transaction": velocity, "party": parties}
    )
    monkeypatch.setitem(plans_data._open, (spark.sparkContext.applicationId, "own rows"), opened)
    monkeypatch.setattr(plans_data, "materialise", None)
    rows = [tuple(r) for r in QUERIES["D6_activity_summary"](spark, "own rows").collect()]
    assert rows[:2] == [("party", "P2", 4.0, 1), ("party", "P1", 2.0, 0)]
    assert [r[1] for r in rows[2:]] == [f"T{i}" for i in range(11, 1, -1)] and rows[2][2] == 0.6875
