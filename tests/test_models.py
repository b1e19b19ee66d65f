import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, models, scoring
from riskloom.settings import ModelJob

SETTINGS = ModelJob(num_trees=8, max_depth=5)


def brute_metrics(rows):
    positives = sum(y for y, _ in rows)
    negatives = len(rows) - positives
    auc = sum((a > b) + 0.5 * (a == b) for y, a in rows for z, b in rows if y and not z) / (positives * negatives)
    ap, previous = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(y for y, s in rows if s >= t)
        recall, precision = tp / positives, tp / sum(s >= t for _, s in rows)
        ap += (recall - previous) * precision
        previous = recall
    return ap, auc


def test_ranking_metrics(spark):
    rng = random.Random(4)
    # many ties at one score
    rows = [(int(rng.random() < 0.3), rng.choice([0.5, 0.5, round(rng.random(), 3)])) for _ in range(250)]
    df = spark.createDataFrame(rows, "label int, score double")
    row = metrics.ranking_metrics(df).first()
    ap, auc = brute_metrics(rows)
    assert (row.average_precision, row.roc_auc) == (pytest.approx(ap), pytest.approx(auc))


def test_undefined_metrics(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "label int, score double")
    row = metrics.ranking_metrics(df).first()
    assert row.average_precision is None and row.roc_auc is None
    decided = metrics.decision_metrics(df.withColumn("prediction", F.lit(0))).first()
    assert (decided.precision, decided.recall, decided.f1) == (0.0, 0.0, 0.0)


def test_thresholds(spark):
    rows = [(1, 0.9), (1, 0.3), (0, 0.25), (0, 0.3), (0, 0.05), (1, 0.05)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = {round(r.threshold, 2): (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_metrics(df).collect()}
    for t in metrics.THRESHOLDS:
        tp = sum(y == 1 and s >= t for y, s in rows)
        fp = sum(y == 0 and s >= t for y, s in rows)
        assert got[t] == (tp, fp, 3 - tp, 3 - fp)
    # F1 is 2/3 both at 0.05 and from 0.30 on: the first wins
    best = metrics.best_threshold(df).first()
    assert (best.threshold, best.f1) == (0.05, pytest.approx(2 / 3))
    assert metrics.best_threshold(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.25)
        rows.append((i, y, rng.gauss(2.0 * y, 1), None if i % 9 == 0 else rng.random(), rng.choice("ab") if i % 7 else None))
    return spark.createDataFrame(rows, "id long, label int, signal double, noise double, kind string")


def test_training_beats_chance(frame):
    rows = {r.model: r for r in models.train_binary_models(frame, key="id", settings=SETTINGS).collect()}
    assert set(rows) == {"logistic_regression", "random_forest"}
    for r in rows.values():
        assert r.roc_auc > 0.8 and 0 < r.average_precision <= 1
        assert r.train_rows + r.test_rows == 600
    assert 0.15 < rows["random_forest"].test_rows / 600 < 0.35
    table = metrics.comparison_table({"t": models.train_binary_models(
        frame, key="id", settings=SETTINGS, kinds=["logistic_regression"])}, ("t", "logistic_regression")).first()
    assert table.f1_delta == 0.0 and table.track == "t"


def test_guards(frame):
    with pytest.raises(ValueError, match="one value of label"):
        models.train_binary_models(frame.where("label = 0"), key="id")
    with pytest.raises(KeyError):
        models.train_node_model(frame)


def test_unknown_category_is_all_zeros(spark, frame):
    train, _ = models.split(frame, "id")
    prepared = models.fit_preprocessor(train, ["signal", "kind"])
    new = spark.createDataFrame([(1.0, "zz"), (1.0, "a"), (None, None)], "signal double, kind string")
    vectors = [r.features.toArray() for r in prepared.transform(new).collect()]
    assert list(vectors[0][1:]) == [0.0, 0.0]
    assert sorted(vectors[1][1:]) == [0.0, 1.0] == sorted(vectors[2][1:])


def test_split_is_stable_and_class_weights(frame):
    one = {r.id for r in models.split(frame, "id")[1].collect()}
    two = {r.id for r in models.split(frame.repartition(7), "id")[1].collect()}
    assert one == two
    counts = {r.label: (r.n, r.w) for r in models.with_class_weight(frame, 0.5).groupBy("label").agg(
        F.count("*").alias("n"), F.max("class_weight").alias("w")).collect()}
    assert counts[0][1] == 1.0 and counts[1][1] == pytest.approx(0.5 * counts[0][0] / counts[1][0])


def test_scores_lookup_and_contributions(spark, frame):
    model = models.fit(frame, ["signal", "noise"], "id")
    scores = scoring.score_accounts(model, frame, 0.4, key="id")
    assert scores.where("is_high_risk <> (fraud_probability >= 0.4)").count() == 0
    asked = spark.createDataFrame([(3,), (10_000,)], "account_id long")
    found = {r.account_id: r.found for r in scoring.lookup(asked, scores).collect()}
    assert found == {3: True, 10_000: False}
    top = scoring.model_contributions(model, frame.where("id = 1"), key="id", k=2).orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2] and top[0].contribution >= top[1].contribution


def test_queue(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.1), ("b", 1, 0.5), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "account_id string, at int, fraud_probability double")
    got = [(r.account_id, r.fraud_probability) for r in scoring.risk_queue(df, order="at", size=2).collect()]
    assert got == [("b", 0.5), ("c", 0.5)]


def test_critical_transactions_and_reports(spark):
    t, b, rev = "account->transfers->account", "account->buys_from->merchant", "merchant->rev_buys_from->account"
    edges = spark.createDataFrame(
        [(t, "1", "2", 1, 30.0, 5), (t, "2", "1", 2, 10.0, 6), (t, "1", "1", 3, 60.0, 7), (b, "1", "m", 1, 30.0, 5),
         (rev, "m", "1", 1, 30.0, 5)],
        "relation string, source_id string, target_id string, transaction_id long, amount double, event_time long",
    )
    risk = spark.createDataFrame([("1", 0.5), ("2", 0.8)], "account_id string, probability double")
    rows = scoring.critical_transactions(edges, risk, k=10)
    got = {(r.account_id, r.relation, r.transaction_id): r.importance for r in rows.collect()}
    assert got[("1", t, 1)] == pytest.approx(0.3 * 0.8)
    assert got[("1", t, 3)] == pytest.approx(0.6 * 0.5)
    assert got[("2", t, 2)] == pytest.approx(0.25 * 0.5)
    assert got[("1", rev, 1)] == pytest.approx(0.5)
    assert len(got) == 7
    top = scoring.critical_transactions(edges, risk, k=1)
    assert {r.account_id: r.transaction_id for r in top.collect()} == {"1": 1, "2": 1}
    scores = spark.createDataFrame([(1, 0.5), (2, 0.8)], "account_id long, fraud_probability double")
    features = spark.createDataFrame(
        [("1", "x", 0.4, 1), ("1", "y", 0.1, 2), ("2", "x", 0.9, 1)],
        "account_id string, feature string, contribution double, rank long",
    )
    report = scoring.highest_risk_report(scores, features, rows).first()
    assert report.account_id == "2" and report.top_features == {"x": 0.9}
    assert [e.transaction_id for e in report.critical_transactions] == [1, 2]


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in scoring.standardise(df, ["a", "b"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_stratified_parts_are_exact(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(1000)] + [(5000 + i, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(5)
    parts = models.stratified_parts(df, "id", validation_size=0.1)
    counts = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert (counts[(1, "test")], counts[(0, "test")]) == (25, 225)
    assert (counts[(1, "validation")], counts[(0, "validation")], counts[(1, "train")]) == (10, 90, 65)
    assert counts[(2, "test")] == 1 and sum(counts.values()) == 1004


def test_medians_and_modes(spark):
    rows = [(1.0, None, "b"), (2.0, None, "a"), (4.0, None, "b"), (9.0, None, None), (None, None, "a"), (float("nan"), None, None)]
    df = spark.createDataFrame(rows, "x double, empty double, t string")
    assert models.exact_medians(df, ["x", "empty"]) == {"x": 3.0, "empty": 0.0}
    assert models.column_modes(df, ["t"]) == {"t": "a"}


def test_tracks_use_the_models_of_the_settings(spark, monkeypatch):
    from riskloom.plans import data as plans

    used = []
    monkeypatch.setattr(models, "train_binary_models", lambda frame, **o: used.append(o["settings"]) or frame)
    monkeypatch.setattr(plans, "materialise", lambda df, name: df)
    df = spark.range(1).selectExpr("id AS node_id", "0 AS is_fraud", "1.0 AS initial_balance", "0 AS alert_count")
    data = plans.RiskData(spark, "none")
    bundle = dict.fromkeys(("tabular_account_features", "node_features", "embeddings", "combined"), df)
    data.__dict__.update(bundle=bundle, transaction_features=df, party_features=df, nodes=df)
    assert len(data.tracks) == 6 and used == [ModelJob()] * 6


def test_stratified_parts_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 60 else None) for i in range(100)], "id long, label int").repartition(3)
    parts = models.stratified_parts(df, "id", validation_size=0.1)
    assert parts.columns == ["id", "label", "part"]
    counts = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert sum(counts.values()) == 100
    assert (counts[(None, "test")], counts[(None, "validation")], counts[(None, "train")]) == (10, 4, 26)


def test_forest_rows_keep_their_nodes(spark, tmp_path):
    """Deep trees are not sent to the tasks at every level, and come out as they did."""
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([float(i % 17), float(i * 7 % 23), float(i % 5)]), float(i * 13 % 29 < 9)) for i in range(300)]
    frame = spark.createDataFrame(rows, ["features", "label"]).repartition(2).cache()
    settings = ModelJob(num_trees=5, max_depth=12)
    estimator = models.random_forest(settings)
    assert estimator.getCacheNodeIds()
    walked = estimator.copy().setCacheNodeIds(False).fit(frame)
    assert estimator.fit(frame).toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_linear_contributions_sort_only_the_best_of_each_row(spark):
    """Ties go to the smaller name, NULL comes last, NaN first; rows of one account are ranked together. No row is expanded
    to all of its features before the ranking."""
    rows = [(1, 1.0, 1.0, 2.0), (2, None, -0.0, 0.0), (3, float("nan"), 5.0, None), (4, 1.0, 2.0, 3.0), (4, 9.0, None, 2.5), (None, 1.0, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "account_id int, b double, a double, B double")
    spark.conf.set("spark.sql.caseSensitive", True)
    try:
        top = scoring.linear_contributions(df, {"b": 2.0, "a": 2.0, "B": 1.0}, k=2)
        got = {(r.account_id, r["rank"]): (r.feature, str(r.contribution)) for r in top.collect()}
        plan = top._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.caseSensitive", False)
    assert got == {
        (1, 1): ("B", "2.0"), (1, 2): ("a", "2.0"),
        (2, 1): ("B", "0.0"), (2, 2): ("a", "-0.0"),
        (3, 1): ("b", "nan"), (3, 2): ("a", "10.0"),
        (4, 1): ("b", "18.0"), (4, 2): ("a", "4.0"),
        (None, 1): ("a", "14.0"), (None, 2): ("B", "2.0"),
    }
    assert "Expand" not in plan
