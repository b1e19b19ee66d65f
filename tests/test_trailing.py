import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import trailing

SCHEMA = "transaction_id {t}, is_cash boolean, entity string, event_step bigint, amount double"


def brute_force(rows, windows, key):
    result = {}
    for e in {r[2] for r in rows}:
        group = sorted((r for r in rows if r[2] == e), key=lambda r: (r[3], key(r[0]), r[1]))
        for position, row in enumerate(group):
            if e is None:
                result[row[0]] = [0.0] + [0.0, 0.0] * len(windows)
                continue
            values = [float(row[3] - group[position - 1][3]) if position else -1.0]
            for w in windows:
                before = [r for r in group[:position] if r[3] >= row[3] - w]
                values += [float(len(before)), round(sum(r[4] for r in before), 4)]
            result[row[0]] = values
    return result


def sample(kind, size=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        # half of the rows belong to one entity and a third to one step
        entity = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        step = 10 if rng.random() < 0.33 else rng.randint(1, 45)
        identifier = {"long": i * 7 % size, "number": str(i * 7 % size), "text": f"TX-{i * 7 % size:06d}"}[kind]
        rows.append((identifier, False, entity, step, round(rng.uniform(1, 100), 2)))
    return rows


@pytest.mark.parametrize("kind", ["long", "number", "text"])
@pytest.mark.parametrize("width", [2**20, 16])
def test_against_brute_force(spark, monkeypatch, kind, width):
    # the small width forces many id slices inside one (entity, step)
    monkeypatch.setattr(trailing, "MIN_SLICE_WIDTH", width)
    rows = sample(kind)
    df = spark.createDataFrame(rows, SCHEMA.format(t="bigint" if kind == "long" else "string")).repartition(5)
    result = trailing.add_trailing_history(df, "entity", "e", windows=(1, 7, 30))
    names = trailing.feature_names("e", (1, 7, 30))
    got = {r.transaction_id: [round(r[n], 4) for n in names[:7]] for r in result.collect()}
    assert got == brute_force(rows, (1, 7, 30), str if kind == "text" else int)


def test_many_slices_limit(spark, monkeypatch):
    monkeypatch.setattr(trailing, "MIN_SLICE_WIDTH", 1)
    monkeypatch.setattr(trailing, "MAX_SLICES", 4)
    rows = sample("long", 200, seed=5)
    df = spark.createDataFrame(rows, SCHEMA.format(t="bigint"))
    result = trailing.add_trailing_history(df, "entity", "e", windows=(1, 3))
    names = trailing.feature_names("e", (1, 3))
    got = {r.transaction_id: [round(r[n], 4) for n in names[:5]] for r in result.collect()}
    assert got == brute_force(rows, (1, 3), int)


def test_ratios_and_duplicate_ids(spark):
    # the same id as a cash row and as a transfer: two events, no fan-out
    rows = [("1", False, "a", 5, 10.0), ("1", True, "a", 5, 20.0), ("2", False, "a", 6, 40.0)]
    df = spark.createDataFrame(rows, SCHEMA.format(t="string"))
    result = trailing.add_trailing_history(df, "entity", "e", windows=(1, 7))
    last = result.where("transaction_id = '2'").first()
    assert result.count() == 3
    assert (last.e_count_prev_1, last.e_amount_prev_7, last.e_velocity_ratio_1_to_7) == (2.0, 30.0, 1.0)
    assert last.e_previous_gap == 1.0


def test_windows_need_one(spark):
    df = spark.createDataFrame([], SCHEMA.format(t="bigint"))
    with pytest.raises(ValueError):
        trailing.add_trailing_history(df, "entity", "e", windows=(7, 30))


def test_party_activity(spark):
    rows = [("A", None, 1, 5.0), ("A", "B", 1, 1.0), ("A", "B", 4, 2.0), ("A", None, 10, 3.0), ("B", "A", 10, 9.0)]
    df = spark.createDataFrame(rows, "source_party_id string, destination_party_id string, event_step bigint, amount double")
    parties = spark.createDataFrame([("A",), ("B",), ("C",)], "party_id string")
    got = {r.party_id: r for r in trailing.party_activity(df, parties).collect()}
    a, b, c = got["A"], got["B"], got["C"]
    # gaps 0, 3, 6
    assert (a.average_outgoing_gap, a.max_outgoing_gap, a.activity_span_steps) == (3.0, 6.0, 9)
    assert (a.outgoing_count_recent_1, a.outgoing_count_recent_7, a.outgoing_amount_recent_7) == (1, 2, 5.0)
    assert a.outgoing_velocity_ratio_1_to_30 == 0.25
    assert (b.average_incoming_gap, b.max_incoming_gap, b.incoming_count_recent_7) == (3.0, 3.0, 1)
    assert (c.first_activity_step, c.last_activity_step, c.outgoing_count_recent_30) == (0, 0, 0)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(sample("long", 150, seed=9), SCHEMA.format(t="bigint"))
    one = trailing.add_trailing_history(df.coalesce(1), "entity", "e")
    many = trailing.add_trailing_history(df.repartition(7, F.rand(1)), "entity", "e")
    assert one.exceptAll(many).count() == 0


def test_ids_over_the_whole_64_bit_range(spark):
    ids = [-9 * 10**18, -5, 3, 9 * 10**18]
    rows = [(i, False, "a", 1 + k // 2, 2.0) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, SCHEMA.format(t="bigint"))
    got = {r.transaction_id: r.e_count_prev_7 for r in trailing.add_trailing_history(df, "entity", "e").collect()}
    assert got == {i: float(k) for k, i in enumerate(ids)}


def test_slice_totals_are_shuffled_once(spark):
    rows = [(str(i), None if i % 7 == 0 else str(i % 5), None if i % 11 == 0 else i % 13, 1.0, False) for i in range(400)]
    events = spark.createDataFrame(rows, "transaction_id string, account string, event_step bigint, amount double, is_cash boolean")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = trailing.add_trailing_history(events, "account", "a", windows=(1, 7))
        got = {r.transaction_id: (r.a_previous_gap, r.a_count_prev_1, r.a_count_prev_7) for r in found.collect()}
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for i, (name, account, step, _, _) in enumerate(rows):
        # rows without an account or a step have no history
        earlier = [s for n, a, s, _, _ in rows if account and step is not None and a == account and s is not None and (s, int(n)) < (step, i)]
        gap = 0.0 if account is None or step is None else step - max(earlier) if earlier else -1.0
        assert got[name] == (gap, *[float(sum(s >= step - w for s in earlier)) for w in (1, 7)]), rows[i]
