import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import flows, graph as graphs, iterative, moves
from riskloom.operators.graph import Graph
from riskloom.plans import graph as plans
from riskloom.settings import GraphJob, Settings

# ring of twelve with four chords
PAIRS = [(i, (i + 1) % 12) for i in range(12)] + [(2, 5), (5, 8), (8, 11), (11, 2)]
VALUES = [10, 11, 40, 8, 12, 45, 9, 10, 50, 11, 9, 55, 42, 48, 53, 46]


def edge_graph(spark, edges, extra=()):
    df = spark.createDataFrame([(a, b, float(w), 1) for a, b, w in edges], "s long, d long, w double, t long")
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e[:2]} | set(extra))], "id long")
    return graphs.build_graph(df, source="s", destination="d", amount="w", time="t", nodes=nodes, node_id="id")


@pytest.fixture(scope="module")
def toy(spark):
    nodes = spark.createDataFrame(
        [(str(i), str(int(i % 3 == 2)), str(100.0 * (i + 1)), str(5) if i % 3 == 2 else None) for i in range(12)],
        "nodeid string, isFraud string, init_balance string, fraudStep string",
    )
    rows = [(str(a), str(b), str(v), str(t + 1)) for t, ((a, b), v) in enumerate(zip(PAIRS, VALUES))]
    transfers = spark.createDataFrame(
        [*rows, ("0", "99", "5", "3"), ("0", None, "5", "3")],
        "sourceNodeId string, targetNodeId string, value string, time string",
    )
    return nodes, transfers


def test_archive_inputs(toy):
    nodes = flows.archive_nodes(toy[0])
    assert nodes.where("fraud_step = -1").count() == 8
    rows = flows.archive_transactions(toy[1], nodes)
    assert rows.count() == 16
    assert rows.select("transaction_id").distinct().count() == 16
    with pytest.raises(KeyError, match="isFraud"):
        flows.archive_nodes(toy[0].drop("isFraud"))
    with pytest.raises(KeyError, match="value"):
        flows.archive_transactions(toy[1].drop("value"), nodes)


def test_flows_and_velocities(toy):
    nodes = flows.archive_nodes(toy[0])
    transfers = flows.archive_transactions(toy[1], nodes)
    pairs = flows.pair_totals(transfers, (1, 7, 30))
    rows = flows.account_flows(nodes, pairs, (1, 7, 30))
    assert len(rows.columns) == 4 + 17 + 18
    two = rows.where("node_id = 2").first()
    assert (two.outgoing_transaction_count, two.outgoing_amount_total, two.outgoing_time_span) == (2, 82.0, 10)
    assert (two.incoming_amount_total, two.net_outgoing_amount) == (57.0, 25.0)
    # latest time 16: the last seven steps start at 10
    assert two.outgoing_tx_velocity_7d == pytest.approx(1 / 7)
    assert two.incoming_amount_velocity_1d == 46.0
    merchants = flows.merchant_features(pairs, (1, 7, 30), pool_size=4)
    assert len(merchants.columns) == 1 + 18
    links = flows.archive_merchant_links(transfers, pool_size=4)
    want = {
        r.merchant_id: (r.n, r.b, r.a)
        for r in links.groupBy("merchant_id")
        .agg(F.count("*").alias("n"), F.countDistinct("source_node_id").alias("b"),
             F.countDistinct("target_node_id").alias("a")).collect()
    }
    got = {r.merchant_id: (r.transaction_count, r.unique_buyer_count, r.unique_anchor_account_count)
           for r in merchants.collect()}
    assert got == want


def test_edges_and_degrees(spark):
    df = spark.createDataFrame(
        [("a", "b", 1.0, 3), ("a", "b", 2.0, 1), ("b", "a", 5.0, 2), ("a", "", 9.0, 1), (None, "b", 1.0, 1)],
        "s string, d string, w double, t long",
    )
    nodes = spark.createDataFrame([("a", 1), ("z", 2)], "id string, tag int")
    g = graphs.build_graph(df, source="s", destination="d", amount="w", time="t", nodes=nodes, node_id="id",
                           attributes=["tag"])
    edges = {(r.src, r.dst): (r.edge_count, r.total_amount, r.first_time, r.last_time) for r in g.edges.collect()}
    assert edges == {("a", "b"): (2, 3.0, 1, 3), ("b", "a"): (1, 5.0, 2, 2)}
    assert {(r.node_id, r.tag) for r in g.vertices.collect()} == {("a", 1), ("b", None), ("z", 2)}
    got = {r.node_id: tuple(r)[1:] for r in graphs.degrees(g).collect()}
    assert got == {"a": (1, 1, 5.0, 3.0), "b": (1, 1, 3.0, 5.0), "z": (0, 0, 0.0, 0.0)}


def dense_pagerank(n, edges, damping=0.85):
    weight = np.zeros((n, n))
    for a, b, w in edges:
        weight[a, b] += w
    out = weight.sum(1)
    step = np.divide(weight, out[:, None], out=np.full((n, n), 1.0 / n), where=out[:, None] > 0)
    x = np.full(n, 1.0 / n)
    for _ in range(300):
        x = damping * x @ step + (1 - damping) / n
    return x


@pytest.mark.parametrize("split", [200_000, 2])
def test_pagerank_with_dangling_nodes_and_loops(spark, monkeypatch, split):
    # the small limit cuts the edges of every hub into pieces
    monkeypatch.setattr(iterative, "EDGES_PER_SPLIT", split)
    edges = [(0, i, i) for i in range(1, 7)] + [(1, 0, 2), (2, 2, 3), (2, 0, 1), (3, 4, 1)]
    ranks = iterative.pagerank(edge_graph(spark, edges, extra=[7]), tolerance=1e-12, max_rounds=200, rounds_per_check=10)
    got = np.array([r.pagerank for r in ranks.orderBy("node_id").collect()])
    assert got.sum() == pytest.approx(1.0)
    assert got == pytest.approx(dense_pagerank(8, edges), abs=1e-9)


def test_components(spark):
    chain = [(i, i + 1, 1) for i in range(20, 60)]
    star = [(100, i, 1) for i in range(101, 110)] + [(3, 100, 1), (5, 5, 1)]
    rows = iterative.connected_components(edge_graph(spark, [*chain, *star], extra=[7])).collect()
    got = {r.node_id: (r.weak_component_id, r.weak_component_size) for r in rows}
    assert {got[i] for i in range(20, 61)} == {(20, 41)}
    assert got[105] == got[3] == (3, 11)
    assert got[5] == (5, 1) and got[7] == (7, 1)


def test_clustering_and_summary(spark):
    # two triangles on the edge 0-1, a tail, a loop, and a reciprocal pair
    edges = [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (3, 0, 1), (3, 1, 1), (3, 4, 1), (2, 2, 1)]
    g = edge_graph(spark, edges, extra=[9])
    coefficients = graphs.clustering(g)
    got = {r.node_id: r.clustering_coefficient for r in coefficients.collect()}
    assert got == pytest.approx({0: 2 / 3, 1: 2 / 3, 2: 1.0, 3: 1 / 3, 4: 0.0, 9: 0.0})
    row = graphs.graph_summary(g, iterative.connected_components(g), coefficients).first()
    assert (row.node_count, row.edge_count, row.weak_component_count, row.largest_weak_component_size) == (6, 8, 2, 5)
    assert row.density == pytest.approx(8 / 30) and row.average_clustering == pytest.approx(sum(got.values()) / 6)


def test_communities_find_planted_groups(spark):
    edges = []
    for base in (0, 10, 20):
        edges += [(base + i, base + j, 1) for i in range(6) for j in range(i)]
    edges += [(0, 10, 1), (10, 20, 1)]
    g = edge_graph(spark, edges, extra=[50])
    rows = iterative.communities(g).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.community_id, set()).add(r.node_id)
    assert sorted(map(sorted, groups.values())) == [
        [0, 1, 2, 3, 4, 5], [10, 11, 12, 13, 14, 15], [20, 21, 22, 23, 24, 25], [50]
    ]
    assert all(r.community_size == len(groups[r.community_id]) for r in rows)


def test_a_round_keeps_volumes_and_tells_its_gain(spark):
    random = np.random.default_rng(3)
    weights = {}
    for a, b, w in zip(random.integers(0, 30, 120), random.integers(0, 30, 120), random.integers(1, 5, 120)):
        if a != b:
            weights[int(min(a, b)), int(max(a, b))] = float(w)
    arcs = [(u, v, w) for (a, b), w in weights.items() for u, v in ((a, b), (b, a))]
    links = spark.createDataFrame(arcs, "u long, v long, w double")
    total = 2 * sum(weights.values())
    degrees = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    state = iterative.save(iterative._with_volumes(degrees.withColumn("community", F.col("node") % 7)))
    rated = iterative.save(iterative._rated(links, state, None, total, F.col("node") % 2 == 0, 1e-7))
    ahead, near, change, moves, waiting = iterative._after(links, state, rated, rated.where("moves"), total)
    score = [iterative.modularity(links, s.select("node", "community"), total) for s in (state, ahead)]
    assert moves > 3 and waiting > 3 and change == pytest.approx(score[1] - score[0], abs=1e-12)
    placed = {r.node: r for r in ahead.collect()}
    volumes = {}
    for r in placed.values():
        volumes[r.community] = volumes.get(r.community, 0.0) + r.k
    assert all(r.volume == volumes[r.community] for r in placed.values())
    moved = {r.node: r.best for r in rated.where("moves").collect()}
    apart = {v for u, v, _ in arcs if u in moved and placed[v].community != moved[u]}
    assert {r.node for r in near.where("apart").collect()} == apart
    # the joins of a round are those of the arcs' two ends
    plan = iterative._rated(links, state, None, total, F.lit(True), 1e-7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_communities_run_until_nothing_gains(spark):
    # merging parts of the light path gains less than 1e-3 of modularity, but more than 1e-7
    g = edge_graph(spark, [(0, 1, 1)] * 20_000 + [(10 + i, 11 + i, 1) for i in range(12)])
    rows = {r.node_id: (r.community_id, r.community_size) for r in iterative.communities(g).collect()}
    assert rows == {0: (0, 2), 1: (0, 2)} | {10 + i: (10, 13) for i in range(13)}
    with pytest.raises(RuntimeError, match="not settled"):
        iterative.communities(g, max_rounds=1)


def test_one_task_makes_the_moves_of_the_distributed_search(spark, monkeypatch):
    random = np.random.default_rng(5)
    ids = [int(i) for i in random.integers(-(2**40), 2**40, 20)]
    edges = [(ids[a], ids[b], int(w)) for a, b, w in zip(random.integers(0, 20, 36), random.integers(0, 20, 36), random.integers(1, 4, 36))]
    g = edge_graph(spark, edges, extra=[7])
    # rated in many blocks, so that they are put together
    monkeypatch.setattr(moves, "BLOCK_ARCS", 5)
    drawn = spark.createDataFrame([(i,) for i in ids], "node long").select("node", F.pmod(F.xxhash64(F.lit(-958), "node"), F.lit(2)).alias("odd"))
    assert {r.node: bool(r.odd) for r in drawn.collect()} == dict(zip(ids, moves.odd_draws(-958, np.array(ids)).tolist()))
    with monkeypatch.context() as patch:
        patch.setattr(iterative, "_local_moves", None)  # no distributed round
        here = {tuple(r) for r in iterative.communities(g).collect()}
    assert len({r[1] for r in here}) > 3
    monkeypatch.setattr(iterative, "TASK_ARCS", 30)  # the first level and the last phase are distributed
    assert {tuple(r) for r in iterative.communities(g).collect()} == here


def test_modularity(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "u long, v long, w double")
    split = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node long, community long")
    assert iterative.modularity(arcs, split, 4.0) == pytest.approx(0.5)
    whole = split.withColumn("community", F.lit(0))
    assert iterative.modularity(arcs, whole, 4.0) == pytest.approx(0.0)


def test_only_products_of_the_embedding_are_written(spark, monkeypatch):
    written = []

    def counted(state):
        written.append(state.columns)
        return plain(state)

    plain = iterative.save
    monkeypatch.setattr(iterative, "save", counted)
    g = edge_graph(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 0, 1)], extra=[9])
    rows = {r.node_id: list(r)[1:] for r in iterative.spectral_embedding(g, dimensions=2, tolerance=1e9).collect()}
    # the start, a product, two products of the only round, and the last one
    assert sum("x0" in columns for columns in written) == 5
    # the hubs are counted once, not for every product
    assert sum("_pieces" in columns for columns in written) == 2
    assert rows.keys() == {0, 1, 2, 3, 9} and rows[9] == [0.0, 0.0] and all(map(any, (rows[n] for n in range(4))))


def test_spectral_embedding_equals_dense_svd(spark, monkeypatch):
    # the small limit cuts the edges of every hub into pieces
    monkeypatch.setattr(iterative, "EDGES_PER_SPLIT", 3)
    rng = np.random.default_rng(0)
    edges = [(i, j, 1) for i in range(14) for j in range(14) for _ in range(rng.poisson(0.8 if i < 7 else 0.3))]
    matrix = np.zeros((14, 14))
    for a, b, _ in edges:
        matrix[a, b] += 1
    rows = iterative.spectral_embedding(
        edge_graph(spark, edges, extra=range(14)), dimensions=3, tolerance=1e-9
    ).orderBy("node_id")
    got = np.array([list(r)[1:] for r in rows.collect()])
    u, s, _ = np.linalg.svd(matrix)
    want = u[:, :3] * s[:3]
    want *= np.sign(want[np.abs(want).argmax(0), range(3)])
    assert got == pytest.approx(want, abs=1e-6)


def test_histogram_and_aggregation(spark, toy):
    nodes = flows.archive_nodes(toy[0])
    transfers = flows.archive_transactions(toy[1], nodes)
    counts = {r.degree: r.node_count for r in graphs.in_degree_histogram(nodes, transfers).collect()}
    assert counts == {1: 8, 2: 4}
    rows = graphs.neighbourhood_aggregation(
        nodes, transfers, ["initial_balance"], source="source_node_id", target="target_node_id"
    )
    five = rows.where("node_id = 5").first()
    assert (five.in_degree, five.initial_balance_mean, five.initial_balance_std) == (2, 400.0, 100.0)
    delta = (8 * np.log(2) + 4 * np.log(3)) / 12
    assert five.initial_balance_max_amplified == pytest.approx(500 * np.log(3) / delta)
    assert five.initial_balance_min_attenuated == pytest.approx(300 * delta / np.log(3))


def test_bundle(toy):
    settings = Settings(graph=GraphJob(embedding_dimensions=4))
    bundle = plans.feature_bundle(*toy, settings=settings)
    assert len(plans.model_columns(bundle["node_features"])) == 49
    assert bundle["node_features"].count() == bundle["embeddings"].count() == 12
    assert [c for c in bundle["combined"].columns if c.startswith("embedding_")] == [f"embedding_{i}" for i in range(4)]
    assert isinstance(bundle["graph"], Graph)
    typed = graphs.typed_edges(
        bundle["node_features"], bundle["merchant_features"], bundle["normalized_transactions"], bundle["merchant_links"]
    )
    assert {r.relation: r["count"] for r in typed.groupBy("relation").count().collect()} == {
        r: 16 for r in graphs.RELATIONS
    }
    with pytest.raises(ValueError, match="transfers"):
        graphs.typed_edges(
            bundle["node_features"], bundle["merchant_features"], bundle["normalized_transactions"].limit(0),
            bundle["merchant_links"],
        )
    assert graphs.top_nodes(bundle["node_features"], "nope").count() == 0


def walks(edges, nodes, seed, damping):
    """Power iteration of the walks that return to the seed."""
    out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    x = {n: float(n == seed) for n in nodes}
    for _ in range(400):
        ahead = {n: (1 - damping) * (n == seed) for n in nodes}
        for a, b, w in edges:
            ahead[b] += damping * x[a] * w / out[a]
        ahead[seed] += damping * sum(x[n] for n in nodes if not out[n])
        x = ahead
    return x


def test_local_pagerank_is_within_its_residuals(spark):
    random = np.random.default_rng(8)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(random.integers(0, 25, 90), random.integers(0, 30, 90), random.integers(1, 9, 90))]
    g = edge_graph(spark, edges + [(40, 41, 1)], extra=range(30))
    seeds = spark.createDataFrame([(0,), (3,), (3,), (99,), (None,)], "node_id long")
    for tolerance in (1e-3, 1e-9):
        found = iterative.local_pagerank(g, seeds, damping=0.7, tolerance=tolerance).collect()
        assert {r.seed for r in found} == {0, 3}
        for seed in (0, 3):
            rows = [r for r in found if r.seed == seed]
            left = sum(r.residual for r in rows)
            assert sum(r.rank for r in rows) + left == pytest.approx(1) and max(r.residual for r in rows) <= tolerance
            merged = {}
            for a, b, w in edges:
                merged[a, b] = merged.get((a, b), 0) + w
            want = walks([(a, b, w) for (a, b), w in merged.items()], range(30), seed, 0.7)
            error = sum(abs(want[n] - next((r.rank for r in rows if r.node_id == n), 0.0)) for n in range(30))
            assert error <= left + 1e-9
            # the other component is not touched
            assert not {r.node_id for r in rows} & {40, 41}
    with pytest.raises(RuntimeError, match="not settled"):
        iterative.local_pagerank(g, seeds, tolerance=1e-9, max_rounds=2)
    assert iterative.local_pagerank(g, seeds.limit(0)).count() == 0
