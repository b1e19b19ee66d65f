import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as X
from riskloom.functions import ordered
from riskloom.functions.ordered import exact_quantiles, keep_first, running_totals, with_slice


def test_coercions(spark):
    df = spark.createDataFrame(
        [(" Yes ", "12.9", "x"), ("1.0", "n/a", None), (None, None, " y "), ("TRUE", "-3.7", "")],
        "Flag string, Num string, Txt string",
    )
    rows = df.select(
        X.flag_column(df, "flag"), X.number_column(df, "NUM", default=-1.0), X.whole_column(df, "num"),
        X.text_column(df, "missing", "txt", default="d"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, 12.9, 12, "x"), (False, -1.0, 0, "d"), (False, -1.0, 0, "y"), (True, -3.7, -3, ""),
    ]
    with pytest.raises(KeyError, match="other"):
        X.require_columns(df, ["Flag", "other"], "table")


def test_hash_bucket_matches_hashlib(spark):
    values = ["0", "17", "a:b", "é", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(X.hash_bucket(F.col("v"), 317, 24, "merchant")).collect()]
    want = [
        f"merchant_{int(hashlib.sha256(f'317:merchant:{v}'.encode()).hexdigest()[:12], 16) % 24:03d}" for v in values
    ]
    assert got == want
    wide = df.select(X.hash_bucket(F.col("v"), 1, 10**9, "p")).first()[0]
    assert wide == f"p_{int(hashlib.sha256(b'1:p:0').hexdigest()[:12], 16) % 10**9:03d}"
    with pytest.raises(ValueError):
        X.hash_bucket(F.col("v"), 1, 0, "p")


def test_safe_arithmetic(spark):
    row = spark.range(1).select(
        X.safe_divide(F.lit(1.0), F.lit(0.0)), X.relative_change(F.lit(-2.0), F.lit(1.0)),
        X.relative_change(F.lit(0.0), F.lit(5.0)), X.trailing_digits(F.lit("ab_007")), X.trailing_digits(F.lit("ab")),
    ).first()
    assert tuple(row) == (0.0, 1.5, 0.0, "007", "0")


@pytest.mark.parametrize("levels", [1, 2])
def test_with_slice(spark, levels):
    size = 16**levels - 1
    rng = random.Random(levels)
    bounds = sorted(rng.choice([rng.uniform(0, 9), 5.0]) for _ in range(size))
    values = [-1.0, 0.0, 5.0, 9.5, *bounds[:10], *[rng.uniform(0, 9) for _ in range(30)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn(
        "b", F.array(*[F.lit(b) for b in bounds])
    )
    got = [r._slice for r in with_slice(df, F.col("v"), "b", levels).collect()]
    assert got == [int(np.searchsorted(bounds, v, side="right")) for v in values]


def test_running_totals_with_a_dominant_group(spark):
    rng = random.Random(3)
    cells = {("hot", round(rng.gauss(0, 1), 4)): rng.randint(1, 5) for _ in range(3000)}
    cells |= {(f"g{i}", float(i)): i for i in range(20)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in cells.items()], "g string, v double, n long")
    got = {(r.g, r.v): r.n_upto for r in running_totals(df, ["g"], "v", ["n"]).collect()}
    want, total = {}, {}
    for (g, v), n in sorted(cells.items()):
        total[g] = total.get(g, 0) + n
        want[(g, v)] = total[g]
    assert got == want


def test_exact_quantiles(spark):
    values = [5.0, 1.0, 1.0, 8.25, 3.5, 9.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    row = exact_quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert list(row) == pytest.approx([np.percentile(values, 25), np.percentile(values, 50), np.percentile(values, 90)])


@pytest.mark.parametrize("bracket", [10_000, 20])
def test_bracketed_quantiles_shuffle_little(spark, monkeypatch, bracket):
    """Several columns at once: near-unique values, few values, NULL and NaN, nothing at all."""
    monkeypatch.setattr(ordered, "BRACKET", bracket)
    held = []
    real = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, name: held.append(real(df, name)) or held[-1])
    random = np.random.default_rng(5)
    values = np.c_[random.lognormal(3, 2, 40_000), random.integers(0, 4, 40_000)]
    rows = [(float(a), int(b), None, float("nan") if i % 3 else float(i)) for i, (a, b) in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double").repartition(6)
    ps = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = ordered.bracketed_quantiles(df, {c: ps for c in "abcd"})
    assert got["a"] == pytest.approx(np.percentile(values[:, 0], [100 * p for p in ps]).tolist(), rel=1e-12)
    assert got["b"] == np.percentile(values[:, 1], [100 * p for p in ps]).tolist() and got["c"] == [None] * 5
    assert got["d"] == pytest.approx(np.percentile([r[3] for r in rows if r[3] == r[3]], [100 * p for p in ps]).tolist())
    if bracket == 10_000:
        assert len(held) == 1 and held[0].count() < 200


def test_quantiles_without_useful_brackets(spark, monkeypatch):
    """Bounds that miss their ranks: all values of the column decide."""
    monkeypatch.setattr(ordered.F, "percentile_approx", lambda c, ps, accuracy: F.array(F.min(c), F.min(c)).cast("array<double>"))
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert ordered.bracketed_quantiles(df, {"x": [0.5, 0.9]})["x"] == pytest.approx([50.0, 90.0])


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "z"), (None, 2, "n"), (None, 1, "m")], "k int, o int, v string")
    assert {(r.k, r.v) for r in keep_first(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "z"), (None, "m")}


def test_running_totals_keep_null_groups_and_reject_null_orders(spark):
    rows = [("a", 1.0, 2), ("a", 3.0, 4), (None, 1.0, 5), (None, 2.0, 6)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): r.n_upto for r in running_totals(df, ["g"], "v", ["n"]).collect()}
    assert got == {("a", 1.0): 2, ("a", 3.0): 6, (None, 1.0): 5, (None, 2.0): 11}
    broken = df.union(spark.createDataFrame([("a", None, 1)], df.schema))
    with pytest.raises(Exception, match="v is NULL"):
        running_totals(broken, ["g"], "v", ["n"]).collect()


def test_money_keeps_small_and_large_amounts(spark):
    small = spark.range(100_000).select(X.money_sum(F.lit(0.00001)).cast("double").alias("s"))
    assert small.first().s == pytest.approx(1.0)
    assert spark.range(3).select(X.money_sum(F.lit(2e14)).cast("double").alias("s")).first().s == 6e14


def test_rows_without_a_key_are_spread_over_the_tasks(spark):
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).cast("string").alias("k"))
    known = spark.createDataFrame([(str(i), i * 10) for i in range(40)] + [(None, -1)], "k string, v int")
    plain, spread = rows.join(known, "k", "left"), X.left_lookup(rows, known, "k", ["id"])
    assert spread.columns == plain.columns
    assert sorted(spread.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = X.left_lookup(rows, known, "k", ["id"]).where("k is null").groupBy(F.spark_partition_id().alias("task")).count()
        sizes = [r["count"] for r in tasks.collect()]
        assert sum(sizes) == 3000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(sizes) < 1.5 * 3000 / len(sizes)
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
