import numpy as np

from riskloom.operators import trailing
from riskloom.session import work_path
from riskloom.streaming import history, jobs

SCHEMA = "transaction_id long, source_account_id string, event_step long, amount double"


def transactions(spark, count, seed=1):
    random = np.random.default_rng(seed)
    steps = np.sort(random.integers(0, 80, count))
    accounts = [None if a == 9 else f"A{min(a, 4)}" for a in random.integers(0, 10, count)]
    rows = [(i, a, int(s), round(float(x), 2)) for i, (a, s, x) in enumerate(zip(accounts, steps, random.uniform(1, 500, count)))]
    return spark.createDataFrame(rows, SCHEMA)


def arrive(rows, folder, low, high):
    rows.where(f"event_step >= {low} AND event_step < {high}").coalesce(1).write.mode("append").parquet(folder)


def shown(df):
    return {r["transaction_id"]: r.asDict() for r in df.collect()}


def test_stream_equals_batch_and_restarts(spark):
    rows = transactions(spark, 400)
    folder, target, offsets = (work_path(spark, n) for n in ("in", "out", "offsets"))

    def run():
        stream = jobs.stream_files(spark, folder, SCHEMA, format="parquet")
        return history.stream_history(stream, "source_account_id", "source", target, offsets, windows=(1, 5, 20))

    arrive(rows, folder, 0, 20)
    arrive(rows, folder, 20, 35)
    first = run()
    assert first.count() == rows.where("event_step < 35").count()
    arrive(rows, folder, 35, 200)  # a restart goes on from the state
    batch = trailing.add_trailing_history(rows, "source_account_id", "source", windows=(1, 5, 20), ids=("transaction_id",))
    assert shown(run()) == shown(batch)
    assert run().count() == 400


def test_state_is_bounded_by_the_longest_window(spark):
    rows = spark.range(300).selectExpr("id AS transaction_id", "'A' AS source_account_id", "id AS event_step", "1D AS amount")
    folder, target, offsets = (work_path(spark, n) for n in ("in", "out", "offsets"))
    for low in (0, 100, 200):
        arrive(rows, folder, low, low + 100)
    stream = jobs.stream_files(spark, folder, SCHEMA, format="parquet")
    found = history.stream_history(stream, "source_account_id", "source", target, offsets, windows=(1, 7))
    assert found.where("source_count_prev_7 = least(event_step, 7) AND source_amount_prev_1 = least(event_step, 1)").count() == 300
    state = spark.read.format("statestore").option("path", offsets).option("stateVarName", "steps").load()
    assert state.count() == 8


def test_late_rows_count_what_is_known(spark):
    folder, target, offsets = (work_path(spark, n) for n in ("in", "out", "offsets"))
    for batch in ([(1, "A", 10, 5.0), (2, "A", 12, None)], [(3, "A", 11, 1.0), (4, None, 3, 1.0), (5, "B", 1, 2.0)], [(6, "A", 2, 1.0)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.stream_files(spark, folder, SCHEMA, format="parquet")
    found = history.stream_history(stream, "source_account_id", "s", target, offsets, windows=(1, 3))
    rows = {r.transaction_id: (r.s_previous_gap, r.s_count_prev_1, r.s_amount_prev_3) for r in found.collect()}
    assert rows == {1: (-1, 0, 0), 2: (2, 0, 5), 3: (1, 1, 5), 4: (0, 0, 0), 5: (-1, 0, 0), 6: (-1, 0, 0)}


def test_rows_of_a_batch_may_come_in_any_order(spark):
    """The history belongs to the row it is written beside, however the rows of an entity arrive."""
    rows = [(3, "A", 30, 4.0), (1, "A", 10, 1.0), (2, "A", 28, 2.0), (10, "A", 30, 8.0)]
    folder, target, offsets = (work_path(spark, n) for n in ("in", "out", "offsets"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    stream = jobs.stream_files(spark, folder, SCHEMA, format="parquet")
    found = shown(history.stream_history(stream, "source_account_id", "source", target, offsets, windows=(1, 5, 20)))
    batch = trailing.add_trailing_history(spark.createDataFrame(rows, SCHEMA), "source_account_id", "source", windows=(1, 5, 20), ids=("transaction_id",))
    assert found == shown(batch)
