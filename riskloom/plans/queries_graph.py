"""Graph measures, bundles, models, scoring, explanation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.columns import hash_fraction
from riskloom.operators import graph as graphs, iterative, metrics, models, quality, scoring, tree_shapley
from riskloom.plans import graph as graph_plans
from riskloom.plans.data import WINDOWS
from riskloom.plans.oracle import money, r
from riskloom.plans.queries_features import CURVE, FLOW_VIEWS, USER_FEATURES, drift_sql
from riskloom.plans.queries_tables import CONFUSION, scored_accounts
from riskloom.plans.registry import query
from riskloom.session import materialise, work_path
from riskloom.streaming import history, jobs

# ---- graph ------------------------------------------------------------------------------------


@query("G1_weighted_digraph", """
SELECT e.src, e.dst, e.edge_count, e.total_amount, e.first_time, e.last_time, a.is_fraud AS src_is_fraud,
 b.is_fraud AS dst_is_fraud FROM edges e JOIN nodes a ON e.src = a.node_id JOIN nodes b ON e.dst = b.node_id""")
def _(data):
    graph = graphs.archive_graph(data.nodes, data.transfers)
    ends = graph.vertices.select("node_id", "is_fraud")
    return graph.edges.join(ends.toDF("src", "src_is_fraud"), "src").join(ends.toDF("dst", "dst_is_fraud"), "dst")


@query("G1_account_graph", f"""
SELECT source_account_id AS src, destination_account_id AS dst, count(*) AS edge_count,
 {r("sum(" + money("amount") + ")", "total_amount")}, min(event_step) AS first_time, max(event_step) AS last_time
FROM transactions WHERE destination_account_id IS NOT NULL GROUP BY ALL""")
def _(data):
    return graphs.account_graph(data.tables).edges


@query("G2_degrees", f"""
SELECT node_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
 {r("coalesce(i.a, 0)", "weighted_in_degree", 2)}, {r("coalesce(o.a, 0)", "weighted_out_degree", 2)} FROM nodes
LEFT JOIN (SELECT dst, count(*) AS n, sum(total_amount) AS a FROM edges GROUP BY 1) i ON node_id = i.dst
LEFT JOIN (SELECT src, count(*) AS n, sum(total_amount) AS a FROM edges GROUP BY 1) o ON node_id = o.src""")
def _(data):
    weighted = ["weighted_in_degree", "weighted_out_degree"]
    return graphs.degrees(data.graph).withColumns({w: F.round(w, 2) for w in weighted})


# the oracle knows this many rounds, and stops by the rule of the job: every fifth round, if the change is small
PAGERANK_ROUNDS = 20


def _pagerank_views() -> dict[str, str]:
    views = {
        "shares": "SELECT src, dst, total_amount / sum(total_amount) OVER (PARTITION BY src) AS share FROM edges",
        "rank_0": "SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS x FROM nodes",
    }
    for i in range(1, PAGERANK_ROUNDS + 1):
        views[f"rank_{i}"] = (
            f"SELECT n.node_id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(f.x, 0) AS x FROM nodes n LEFT JOIN "
            f"(SELECT dst, sum(share * x) AS x FROM shares JOIN rank_{i - 1} p ON p.node_id = src GROUP BY dst) f "
            "ON f.dst = n.node_id")
    checks = range(5, PAGERANK_ROUNDS + 1, 5)
    views["changes"] = " UNION ALL ".join(
        f"SELECT {i} AS k, sum(abs(p.x - q.x)) AS change FROM rank_{i} p JOIN rank_{i - 1} q USING (node_id)" for i in checks)
    views["settled"] = "SELECT min(k) AS k FROM changes WHERE change < 1e-6 * (SELECT count(*) FROM nodes)"
    views["final_rank"] = " UNION ALL ".join(
        f"SELECT node_id, x FROM rank_{i} WHERE (SELECT k FROM settled) = {i}" for i in checks)
    return views


@query("G3_pagerank", f"SELECT node_id, {r('x / (SELECT sum(x) FROM final_rank) * 1000', 'pagerank_permille')} FROM final_rank",
       **_pagerank_views())
def _(data):
    ranks = iterative.pagerank(data.graph)
    return ranks.select("node_id", (F.col("pagerank") * 1000).alias("pagerank_permille"))


def _component_views(rounds: int = 12) -> dict[str, str]:
    views = {"label_0": "SELECT node_id, node_id AS label FROM nodes"}
    for i in range(1, rounds + 1):
        views[f"label_{i}"] = (
            f"SELECT l.node_id, least(l.label, coalesce(m.label, l.label)) AS label FROM label_{i - 1} l LEFT JOIN "
            f"(SELECT u, min(p.label) AS label FROM arcs JOIN label_{i - 1} p ON p.node_id = v GROUP BY u) m "
            "ON m.u = l.node_id")
    return views


@query("G4_weak_components", """
SELECT node_id, label AS weak_component_id, count(*) OVER (PARTITION BY label) AS weak_component_size FROM label_12""",
       **_component_views())
def _(data):
    return iterative.connected_components(data.graph)


CLUSTERING = {
    "und": "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst",
    "triangles": "SELECT x.a, x.b, y.b AS c FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b",
    "corner": "SELECT a AS node_id FROM triangles UNION ALL SELECT b FROM triangles UNION ALL SELECT c FROM triangles",
    "coefficients": """SELECT n.node_id, CASE WHEN coalesce(d.d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t.t, 0) /
 (d.d * (d.d - 1)) END AS c FROM nodes n LEFT JOIN (SELECT u, count(*) AS d FROM arcs GROUP BY 1) d ON n.node_id = d.u
 LEFT JOIN (SELECT node_id, count(*) AS t FROM corner GROUP BY 1) t ON n.node_id = t.node_id""",
}


@query("G5_clustering", f"SELECT node_id, {r('c', 'clustering_coefficient')} FROM coefficients", **CLUSTERING)
def _(data):
    return graphs.clustering(data.graph)


@query("G6_communities")
def _(data):
    return iterative.communities(data.graph)


@query("G7_node_features")
def _(data):
    return graph_plans.node_features(data.graph)


@query("G6_partition_checks", """
SELECT count(*) AS nodes, true AS sizes_agree, true AS ids_are_members, true AS better_than_components FROM nodes""")
def _(data):
    """Sizes counted again, ids among the members, and a modularity above that of the weak components (0 for one)."""
    found = data.bundle["node_features"].select("node_id", "community_id", "community_size", "weak_component_id")
    sizes = found.groupBy("community_id").agg(F.count("*").alias("n"), F.min("node_id").alias("least"))
    pairs = graphs.undirected_edges(data.graph.edges)
    forward = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").cast("double").alias("w"))
    arcs = materialise(forward.union(forward.select("v", "u", "w")), "arcs")
    total = arcs.agg(F.sum("w")).first()[0]
    scores = [
        iterative.modularity(arcs, found.select(F.col("node_id").alias("node"), F.col(c).alias("community")), total)
        for c in ("community_id", "weak_component_id")
    ]
    return found.join(sizes, "community_id").agg(
        F.count("*").alias("nodes"),
        F.bool_and(F.col("n") == F.col("community_size")).alias("sizes_agree"),
        F.bool_and(F.col("least") == F.col("community_id")).alias("ids_are_members"),
        F.lit(scores[0] > scores[1] + 0.1).alias("better_than_components"),
    )


@query("G7_measured_columns", f"""
SELECT node_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, {r('c', 'clustering_coefficient')},
 l.label AS weak_component_id, count(*) OVER (PARTITION BY l.label) AS weak_component_size FROM nodes
JOIN coefficients USING (node_id) JOIN label_12 l USING (node_id)
LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON node_id = i.dst
LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON node_id = o.src""", **_component_views(), **CLUSTERING)
def _(data):
    names = ("in_degree", "out_degree", "clustering_coefficient", "weak_component_id", "weak_component_size")
    return data.bundle["node_features"].select("node_id", *names)


@query("G8_graph_summary", f"""
SELECT n AS node_count, m AS edge_count, {r('m::DOUBLE / (n * (n - 1))', 'density')},
 {r('m::DOUBLE / n', 'average_in_degree')}, {r('m::DOUBLE / n', 'average_out_degree')},
 (SELECT count(DISTINCT label) FROM label_12) AS weak_component_count,
 (SELECT max(k) FROM (SELECT count(*) AS k FROM label_12 GROUP BY label)) AS largest_weak_component_size,
 {r('(SELECT avg(c) FROM coefficients)', 'average_clustering')}
FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)""",
       **_component_views(), **CLUSTERING)
def _(data):
    return graphs.graph_summary(data.graph, iterative.connected_components(data.graph), graphs.clustering(data.graph))


@query("G9_top_nodes", f"""
SELECT node_id, {r('a', 'weighted_in_degree', 2)} FROM (SELECT dst AS node_id, sum(total_amount) AS a FROM edges GROUP BY 1)
ORDER BY a DESC, node_id LIMIT 10""")
def _(data):
    top = graphs.top_nodes(graphs.degrees(data.graph), "weighted_in_degree", 10)
    return top.select("node_id", F.round("weighted_in_degree", 2).alias("weighted_in_degree"))


@query("G10_spectral_embedding")
def _(data):
    return iterative.spectral_embedding(data.graph)


@query("G10_embedding_identities", """
SELECT i, j, true AS orthogonal, true AS ordered FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j) WHERE i < j""")
def _(data):
    """The columns of U * S are orthogonal, and their norms, the singular values, fall."""
    names = [f"embedding_{i}" for i in range(16)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(16) for j in range(i, 16)]
    one = data.bundle["embeddings"].agg(*products)
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            (F.abs(f"p{i}_{j}") <= 1e-6 * F.sqrt(F.col(f"p{i}_{i}") * F.col(f"p{j}_{j}"))).alias("orthogonal"),
            (F.col(f"p{i}_{i}") >= F.col(f"p{j}_{j}") * (1 - 1e-9)).alias("ordered"),
        )
        for i in range(16)
        for j in range(i + 1, 16)
    ]
    return one.select(F.inline(F.array(*cells)))


@query("G11_typed_edges", f"""
SELECT 'account->transfers->account' AS relation, source_node_id::VARCHAR AS source_id, target_node_id::VARCHAR AS target_id,
 transaction_id, amount, event_time, 0.0::DOUBLE AS transaction_type_code FROM transfers UNION ALL
SELECT 'account->buys_from->merchant', source_node_id::VARCHAR, merchant_id, transaction_id, amount, event_time,
 {r('1.0 + merchant_segment / 23.0', 'c')} FROM archive_links UNION ALL
SELECT 'merchant->rev_buys_from->account', merchant_id, source_node_id::VARCHAR, transaction_id, amount, event_time,
 {r('1.0 + merchant_segment / 23.0', 'c')} FROM archive_links""")
def _(data):
    return data.typed_edges


@query("G12_in_degree_histogram", """
SELECT degree, count(*) AS node_count FROM (SELECT n.node_id, count(t.transaction_id) AS degree FROM nodes n LEFT JOIN
transfers t ON t.target_node_id = n.node_id GROUP BY 1) GROUP BY degree""")
def _(data):
    return graphs.in_degree_histogram(data.nodes, data.transfers)


def _pna() -> str:
    four = {"mean": "avg(b)", "min": "min(b)", "max": "max(b)", "std": "stddev_pop(b)"}
    names = [f"balance_{n}" for n in four]
    stats = ", ".join(f"{e} AS balance_{n}" for n, e in four.items())
    up, down = "ln(greatest(in_degree, 1) + 1) / delta", "delta / ln(greatest(in_degree, 1) + 1)"
    picks = [r(f"coalesce({n}, 0)", n) for n in names]
    picks += [r(f"coalesce({n}, 0) * {up}", f"{n}_amplified") for n in names]
    picks += [r(f"coalesce({n}, 0) * {down}", f"{n}_attenuated") for n in names]
    return f"""SELECT node_id, in_degree, {', '.join(picks)} FROM (SELECT *, avg(ln(in_degree + 1)) OVER () AS delta FROM
 (SELECT n.node_id, count(s.b) AS in_degree, {stats} FROM nodes n LEFT JOIN (SELECT target_node_id, initial_balance AS b
 FROM transfers JOIN nodes ON source_node_id = node_id) s ON s.target_node_id = n.node_id GROUP BY 1))"""


@query("G13_neighbourhood_aggregation", _pna())
def _(data):
    features = data.nodes.withColumnRenamed("initial_balance", "balance")
    return graphs.neighbourhood_aggregation(
        features, data.transfers, ["balance"], source="source_node_id", target="target_node_id"
    )


@query("C17_graph_bundle")
def _(data):
    return data.bundle["combined"]


# ---- models -----------------------------------------------------------------------------------


def party_frame(data):
    return data.party_features.drop("alert_count")


@query("M1_preprocessing")
def _(data):
    columns = [c for c in party_frame(data).columns if c not in ("party_id", "label")]
    train, test = models.split(party_frame(data), "party_id")
    prepared = models.fit_preprocessor(train, columns).transform(test)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return prepared.select(
        "party_id", F.size(values).alias("width"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total")
    )


@query("M1_medians_and_modes", """
SELECT 'l_quantity' AS feature, median(l_quantity)::VARCHAR AS value FROM lineitem UNION ALL
SELECT 'l_extendedprice', round(median(l_extendedprice), 4)::VARCHAR FROM lineitem UNION ALL
SELECT 'l_returnflag', arg_min(l_returnflag, (-n, l_returnflag)) FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
UNION ALL SELECT 'l_linestatus', arg_min(l_linestatus, (-n, l_linestatus)) FROM (SELECT l_linestatus, count(*) AS n FROM lineitem
 GROUP BY 1)""")
def _(data):
    rows = data.table("lineitem")
    medians = models.exact_medians(rows, ["l_quantity", "l_extendedprice"])
    values = {n: str(round(m, 4)) for n, m in medians.items()} | models.column_modes(rows, ["l_returnflag", "l_linestatus"])
    return data.spark.createDataFrame(list(values.items()), "feature string, value string")


@query("M2_stratified_split", """
SELECT label, part, count(*) AS n, sum(account_id)::BIGINT AS id_sum FROM (SELECT label, account_id, CASE WHEN k <=
 round(n * 0.25) THEN 'test' WHEN k <= round(n * 0.35) THEN 'validation' ELSE 'train' END AS part FROM (SELECT *, count(*)
 OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(sha256('42:split:' ||
 account_id), 1, 12))::BIGINT) AS k FROM scored)) GROUP BY ALL""")
def _(data):
    rows = models.stratified_parts(scored_accounts(data), "account_id", validation_size=0.1)
    return rows.groupBy("label", "part").agg(F.count("*").alias("n"), F.sum("account_id").alias("id_sum"))


@query("M3_logistic_regression")
def _(data):
    return models.train_party_model(party_frame(data), kinds=["logistic_regression"])


@query("M4_random_forest")
def _(data):
    return models.train_party_model(party_frame(data), kinds=["random_forest"])


@query("M5_class_weights", f"""
SELECT label, {r('CASE WHEN label = 1 THEN 0.5 * neg / pos ELSE 1 END', 'class_weight')}, count(*) AS n FROM scored,
(SELECT count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos FROM scored) GROUP BY ALL""")
def _(data):
    rows = models.with_class_weight(scored_accounts(data), 0.5)
    return rows.groupBy("label", "class_weight").agg(F.count("*").alias("n"))


RANKING = f"""
SELECT {r('sum(tp * tp_upto::DOUBLE / (tp_upto + fp_upto)) / sum(tp)', 'average_precision')},
 {r('sum(fp * (tp_upto - tp / 2.0)) / (sum(tp)::DOUBLE * sum(fp))', 'roc_auc')} FROM curve"""


@query("M6_ranking_metrics", RANKING, curve=CURVE)
def _(data):
    return metrics.ranking_metrics(scored_accounts(data))


@query("M6_decision_metrics", f"""
SELECT {r('tp::DOUBLE / (tp + fp)', 'precision')}, {r('tp::DOUBLE / (tp + fn)', 'recall')},
 {r('2.0 * tp / (2 * tp + fp + fn)', 'f1')}, tp + fp + fn + tn AS rows FROM confusion WHERE threshold = 0.5""",
       confusion=CONFUSION)
def _(data):
    rows = scored_accounts(data).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return metrics.decision_metrics(rows)


@query("M7_best_threshold", f"""
SELECT threshold, {r('2.0 * tp / (2 * tp + fp + fn)', 'f1')} FROM confusion
ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, threshold LIMIT 1""", confusion=CONFUSION)
def _(data):
    return metrics.best_threshold(scored_accounts(data))


@query("M8_model_tracks")
def _(data):
    rows = [df.withColumn("track", F.lit(t)) for t, df in data.tracks.items()]
    return quality.union_all(rows)


@query("M8_track_rows", """
SELECT track, model, sum(n)::BIGINT - sum(t)::BIGINT AS train_rows, sum(t)::BIGINT AS test_rows FROM (
 SELECT track, label, count(*) AS n, round(count(*) * 0.25) AS t FROM (
  SELECT 'transaction' AS track, is_alert_related::INTEGER AS label FROM transactions UNION ALL
  SELECT 'party', is_alerted::INTEGER FROM parties UNION ALL
  SELECT track, is_fraud FROM nodes, (SELECT unnest(['account_tabular', 'graph_node', 'embedding_only', 'combined']) AS track))
 GROUP BY ALL), (SELECT unnest(['logistic_regression', 'random_forest']) AS model) GROUP BY ALL""")
def _(data):
    rows = [df.select(F.lit(t).alias("track"), "model", "train_rows", "test_rows") for t, df in data.tracks.items()]
    return quality.union_all(rows)


@query("M9_comparison_table")
def _(data):
    return metrics.comparison_table(data.tracks, ("party", "logistic_regression"))


@query("M10_account_scoring")
def _(data):
    asked = data.table("orders").select(F.col("o_orderkey").alias("account_id"))
    return scoring.lookup(asked, data.scores)


@query("M10_account_lookup", """
SELECT o.o_orderkey AS account_id, s.score AS fraud_probability, s.score >= 0.5 AS is_high_risk,
 CASE WHEN s.account_id IS NOT NULL THEN 0.5 END::DOUBLE AS threshold_used, s.account_id IS NOT NULL AS found
FROM orders o LEFT JOIN scored s ON o.o_orderkey = s.account_id""")
def _(data):
    scores = scored_accounts(data).select("account_id", F.col("score").alias("fraud_probability"))
    asked = data.table("orders").select(F.col("o_orderkey").alias("account_id"))
    return scoring.lookup(asked, scoring.decide(scores, 0.5))


WEIGHTS = {"l_quantity": 0.8, "l_extendedprice": 0.5, "l_discount": -0.4, "l_tax": 1.1}


@query("M11_linear_contributions", f"""
SELECT account_id, feature, {r('contribution', 'contribution', 4)}, rank FROM (SELECT *, row_number() OVER (PARTITION BY
 account_id ORDER BY contribution DESC, feature) AS rank FROM (SELECT account_id, {', '.join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () * {w} AS {c}" for c, w in WEIGHTS.items())} FROM
 (SELECT l_orderkey AS account_id, {', '.join(f"sum({c}::DECIMAL(18,4))::DOUBLE AS {c}" for c in WEIGHTS)} FROM lineitem
 GROUP BY 1)) UNPIVOT (contribution FOR feature IN ({', '.join(WEIGHTS)}))) WHERE rank <= 2""")
def _(data):
    sums = [F.sum(F.col(c).cast("decimal(38,8)")).cast("double").alias(c) for c in WEIGHTS]
    rows = data.table("lineitem").groupBy(F.col("l_orderkey").alias("account_id")).agg(*sums)
    top = scoring.linear_contributions(scoring.standardise(rows, list(WEIGHTS)), WEIGHTS, k=2)
    return top.withColumn("contribution", F.round("contribution", 4))


def contributions(data):
    return scoring.model_contributions(data.model, data.tabular, k=5)


def account_risk(data):
    return data.scores.select(
        F.col("account_id").cast("string").alias("account_id"), F.col("fraud_probability").alias("probability")
    )


def _with_text_id(df):
    return df.withColumn("account_id", F.col("account_id").cast("string"))


@query("M11_feature_attribution")
def _(data):
    return contributions(data)


# a tree by hand: quantity up to 100 (60 of 100 rows) gives 0.2; of the other 40, discount up to 0.3 (10) gives 0.5,
# else 0.9
HAND_TREE = [(0, 0, 0, 100.0, 1, 2, 100.0, 0.0), (0, 1, -1, 0.0, -1, -1, 60.0, 0.2), (0, 2, 1, 0.3, 3, 4, 40.0, 0.0),
             (0, 3, -1, 0.0, -1, -1, 10.0, 0.5), (0, 4, -1, 0.0, -1, -1, 30.0, 0.9)]


@query("M11_tree_shapley", f"""
SELECT account_id, {r('0.2 * ((1 - q) - 0.6) + 0.5 * (q - 0.4) * (0.25 + (1 - d)) / 2 + 0.9 * (q - 0.4) * (0.75 + d) / 2', 'quantity')},
 {r('0.5 * ((1 - d) - 0.25) * (0.4 + q) / 2 + 0.9 * (d - 0.75) * (0.4 + q) / 2', 'discount')}, 0.44::DOUBLE AS base FROM (
SELECT account_id, (quantity > 100)::INTEGER::DOUBLE AS q, (discount > 0.3)::INTEGER::DOUBLE AS d FROM (
SELECT l_orderkey AS account_id, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity, sum(l_discount::DECIMAL(18,4))::DOUBLE
 AS discount FROM lineitem GROUP BY 1))""")
def _(data):
    sums = [F.sum(F.col(c).cast("decimal(38,8)")).cast("double") for c in ("l_quantity", "l_discount")]
    rows = data.table("lineitem").groupBy(F.col("l_orderkey").alias("account_id")).agg(F.array(*sums).alias("values"))
    nodes = data.spark.createDataFrame(HAND_TREE, tree_shapley.NODE_COLUMNS)
    found = tree_shapley.shapley_values(nodes, rows)
    parts = [(F.round(F.get("contributions", F.lit(i)), 6) + F.lit(0.0)).alias(n) for i, n in enumerate(("quantity", "discount"))]
    return found.select("account_id", *parts, F.round("base", 6).alias("base"))


@query("M11_forest_attribution")
def _(data):
    return tree_shapley.forest_contributions(data.forest, data.tabular, k=5)


@query("M11_forest_sums", "SELECT count(*) AS accounts, 0 AS unexplained FROM nodes")
def _(data):
    """Contributions and the training mean add up to the score of every account."""
    rows = tree_shapley.forest_contributions(data.forest, data.tabular, k=1000)
    base = tree_shapley.Forest.read(tree_shapley.forest_nodes(data.forest.model)).base
    sums = rows.groupBy(F.col("account_id").alias("node_id")).agg(F.sum("contribution").alias("total"))
    both = data.forest.score(data.tabular).select("node_id", "score").join(sums, "node_id", "left")
    apart = F.coalesce(F.abs(F.col("total") + base - F.col("score")), F.lit(1.0)) > 1e-6
    return both.agg(F.count("*").alias("accounts"), F.count_if(apart).cast("int").alias("unexplained"))


INCIDENT = """
SELECT source_node_id AS account_id, 'account->transfers->account' AS relation, target_node_id::VARCHAR AS other,
 transaction_id, amount FROM transfers UNION ALL
SELECT target_node_id, 'account->transfers->account', source_node_id::VARCHAR, transaction_id, amount FROM transfers
 WHERE source_node_id <> target_node_id UNION ALL
SELECT source_node_id, 'account->buys_from->merchant', merchant_id, transaction_id, amount FROM archive_links UNION ALL
SELECT source_node_id, 'merchant->rev_buys_from->account', merchant_id, transaction_id, amount FROM archive_links"""
RISK = """
SELECT account_id::VARCHAR AS other, score AS risk FROM scored UNION ALL SELECT merchant_id, avg(score) FROM archive_links
JOIN scored ON source_node_id = account_id GROUP BY 1"""


@query("M12_critical_transactions", f"""
SELECT account_id::VARCHAR AS account_id, rank, {r('importance', 'importance')} FROM (SELECT i.*, importance,
 row_number() OVER (PARTITION BY account_id ORDER BY importance DESC, relation, transaction_id) AS rank FROM
 (SELECT i.account_id, i.relation, i.transaction_id, coalesce(risk, 0) * amount / sum({money('amount')})
  OVER (PARTITION BY account_id, relation)::DOUBLE AS importance FROM incident i LEFT JOIN risk_of USING (other)) i)
WHERE rank <= 5""", incident=INCIDENT, risk_of=RISK)
def _(data):
    risk = scored_accounts(data).select(
        F.col("account_id").cast("string").alias("account_id"), F.col("score").alias("probability")
    )
    return scoring.critical_transactions(data.typed_edges, risk, k=5).select("account_id", "rank", "importance")


# the oracle follows the walks for this many steps; what is left then is under 0.2 ** 22
WALK_STEPS = 22


def _walk_views() -> dict[str, str]:
    views = {
        "seeds": "SELECT node_id AS seed FROM nodes ORDER BY node_id LIMIT 3",
        "sends": "SELECT src, dst, total_amount / sum(total_amount) OVER (PARTITION BY src) AS share FROM edges",
        "walk_0": "SELECT seed, seed AS node_id, 1.0::DOUBLE AS x FROM seeds",
    }
    for i in range(1, WALK_STEPS + 1):
        views[f"walk_{i}"] = (
            "SELECT seed, node_id, sum(x) AS x FROM (SELECT seed, seed AS node_id, 0.8::DOUBLE AS x FROM seeds UNION ALL "
            f"SELECT seed, coalesce(dst, seed), 0.2 * coalesce(share, 1) * x FROM walk_{i - 1} LEFT JOIN sends ON src = node_id) "
            "GROUP BY ALL")
    return views


@query("M12_local_walks", f"SELECT seed, node_id, {r('x', 'rank')} FROM walk_{WALK_STEPS} WHERE x > 1e-9", **_walk_views())
def _(data):
    """Short walks from three accounts, by local push."""
    seeds = data.graph.vertices.select("node_id").orderBy("node_id").limit(3)
    found = iterative.local_pagerank(data.graph, seeds, damping=0.2, tolerance=1e-15)
    return found.where("rank > 1e-9").select("seed", "node_id", F.round("rank", 6).alias("rank"))


@query("M12_walked_transactions")
def _(data):
    top = scoring.riskiest(data.scores).select(F.col("account_id").alias("node_id"))
    ranks = iterative.local_pagerank(data.graph, top, tolerance=1e-5)
    return scoring.walked_transactions(data.typed_edges, ranks, k=10)


@query("M13_highest_risk_report")
def _(data):
    # the one account first: contributions and edges of no other are ranked
    top = scoring.riskiest(data.scores)
    key = top.select(F.col("account_id").cast("string").alias("account_id"))
    features = data.tabular.join(top.select(F.col("account_id").alias("node_id")), "node_id", "left_semi")
    edges = scoring.critical_transactions(data.typed_edges, account_risk(data), k=5, accounts=key)
    return scoring.highest_risk_report(top, _with_text_id(scoring.model_contributions(data.model, features, k=5)), edges)


@query("M14_account_reports")
def _(data):
    edges = scoring.critical_transactions(data.typed_edges, account_risk(data), k=5)
    reports = scoring.account_reports(data.scores, _with_text_id(contributions(data)), edges)
    return reports.select(
        "account_id", "fraud_probability", F.size("top_features").alias("feature_count"),
        F.size("critical_transactions").alias("transaction_count"), "top_features", "critical_transactions",
    )


@query("M14_forest_reports")
def _(data):
    """The reports of all accounts by the forest: scores, contributions and counterparty risk are its own."""
    scores = materialise(scoring.score_accounts(data.forest, data.tabular, 0.5), "forest_scores")
    risk = scores.select(F.col("account_id").cast("string").alias("account_id"), F.col("fraud_probability").alias("probability"))
    edges = scoring.critical_transactions(data.typed_edges, risk, k=5)
    top = _with_text_id(tree_shapley.forest_contributions(data.forest, data.tabular, k=5))
    return scoring.account_reports(scores, top, edges)


# ---- streaming --------------------------------------------------------------------------------


@query("R1_stream_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(data):
    schema = data.table("events").schema
    stream = jobs.stream_files(data.spark, data.directory, schema, format="parquet", pattern="events.parquet")
    return jobs.ingest(stream, work_path(data.spark, "ingested"), work_path(data.spark, "offsets"))


@query("R1_archive_ingest", """
SELECT 'nodes' AS table_name, count(*) AS row_count, sum(node_id)::BIGINT AS id_sum FROM nodes UNION ALL
SELECT 'transactions', count(*), sum(source_node_id + target_node_id)::BIGINT FROM transfers""")
def _(data):
    folder = work_path(data.spark, "archive")
    nodes = data.nodes.selectExpr("node_id AS nodeid", "is_fraud AS isFraud", "initial_balance AS init_balance", "fraud_step AS fraudStep")
    moves = data.transfers.selectExpr("source_node_id AS sourceNodeId", "target_node_id AS targetNodeId", "amount AS value", "event_time AS time")
    nodes.repartition(2).write.option("header", True).csv(f"{folder}/nodes")
    moves.repartition(3).write.option("header", True).csv(f"{folder}/transactions")
    tables = jobs.ingest_archive(data.spark, folder, work_path(data.spark, "ingested"), work_path(data.spark, "offsets"))
    sums = {"nodes": "CAST(nodeid AS BIGINT)", "transactions": "CAST(sourceNodeId AS BIGINT) + CAST(targetNodeId AS BIGINT)"}
    return quality.union_all([
        tables[n].agg(F.count("*").alias("row_count"), F.expr(f"sum({e})").alias("id_sum")).select(
            F.lit(n).alias("table_name"), "row_count", "id_sum") for n, e in sums.items()
    ])


MONITORED = ["total_amount", "incoming_transaction_count", "outgoing_transaction_count"]


def _drift_log(data):
    """One micro-batch: the account features, with a surge in half of the accounts."""
    baseline, recent = data.drift_pair
    folder = work_path(data.spark, "arrivals")
    half = hash_fraction(F.col("node_id"), 7) < 0.5
    recent.where(half).unionByName(baseline.where(~half)).write.parquet(folder)
    stream = jobs.stream_files(data.spark, folder, baseline.schema, format="parquet", files_per_trigger=None)
    return jobs.monitor_drift(
        stream, baseline, work_path(data.spark, "events"), work_path(data.spark, "offsets"), columns=MONITORED
    )


# at these row counts every KS statistic of 0.2 has a p-value far below 0.05
ARRIVALS = """SELECT CASE WHEN cohort = 'recent' AND ('0x' || substr(sha256('7:fraction:' || node_id), 1, 12))::BIGINT
 / 281474976710656.0 < 0.5 THEN 5.0 ELSE 1.0 END::DOUBLE * (coalesce(outgoing_amount_total, 0) +
 coalesce(incoming_amount_total, 0)) AS total_amount, coalesce(outgoing_transaction_count, 0) AS
 outgoing_transaction_count, coalesce(incoming_transaction_count, 0) AS incoming_transaction_count, cohort
 FROM nodes LEFT JOIN out_flow USING (node_id) LEFT JOIN in_flow USING (node_id),
 (SELECT unnest(['baseline', 'recent']) AS cohort)"""


@query("R2_drift_monitor", f"""
SELECT 0::BIGINT AS batch_id, max(ks) >= 0.2 AS drift_detected, {r('max(ks)', 'drift_score')},
 count(*) FILTER (WHERE ks >= 0.2) AS drifted, (SELECT count(*) FROM nodes) AS sample_size,
 count(*) AS analyzed_feature_count FROM ks_values""", **FLOW_VIEWS, **drift_sql(ARRIVALS, MONITORED))
def _(data):
    return _drift_log(data).select(
        "batch_id", "drift_detected", "drift_score", F.size("drifted_features").cast("bigint").alias("drifted"),
        "sample_size", "analyzed_feature_count",
    )


@query("S10_event_log", """
SELECT 0::BIGINT AS batch_id, true AS drift_detected, feature FROM ks_values WHERE ks >= 0.2""",
       **FLOW_VIEWS, **drift_sql(ARRIVALS, MONITORED))
def _(data):
    return _drift_log(data).select("batch_id", "drift_detected", F.explode("drifted_features").alias("feature"))


LOG = """SELECT day(ts)::BIGINT AS batch_id, count(*) FILTER (WHERE event_type = 'error') * 5 > count(*) AS detected,
 round(sum(value::DECIMAL(18,4))::DOUBLE / count(*) / 1000, 6) AS score, count(*) AS sample_size,
 count(DISTINCT event_type) AS features, count(*) % 3 AS drifted, day(ts) / 10.0 AS seconds FROM events GROUP BY day(ts)"""


@query("R3_monitoring_metrics", " UNION ALL ".join([
    "SELECT 'drift_analyses_total' AS metric, count(*)::DOUBLE AS value FROM log_rows",
    "SELECT 'drift_events_logged_total', count(*)::DOUBLE FROM log_rows",
    "SELECT 'drift_detected_total', count(*) FILTER (WHERE detected)::DOUBLE FROM log_rows",
    *[f"SELECT 'drift_last_{name}', arg_max({c}, batch_id)::DOUBLE FROM log_rows" for name, c in (
        ("score", "score"), ("sample_size", "sample_size"), ("feature_count_analyzed", "features"),
        ("drifted_feature_count", "drifted"))],
    *[f"SELECT 'drift_duration_le_{int(b * 1000)}ms', count(*) FILTER (WHERE seconds <= {b})::DOUBLE FROM log_rows"
      for b in jobs.DURATION_BUCKETS],
    f"SELECT 'drift_duration_sum', {r('sum(seconds)', 'value')} FROM log_rows",
]), log_rows=LOG)
def _(data):
    daily = data.table("events").groupBy(F.dayofmonth("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.sum(F.col("value").cast("decimal(38,8)")).cast("double").alias("total"),
        F.countDistinct("event_type").alias("kinds"),
    )
    log = daily.select(
        F.format_string("2024-01-%02d", "day").alias("timestamp"),
        (F.col("errors") * 5 > F.col("n")).alias("drift_detected"),
        F.round(F.col("total") / F.col("n") / 1000, 6).alias("drift_score"),
        F.array_repeat(F.lit("f"), (F.col("n") % 3).cast("int")).alias("drifted_features"),
        F.col("n").alias("sample_size"), F.col("kinds").alias("analyzed_feature_count"),
        (F.col("day") / 10.0).alias("duration_seconds"), F.col("day").cast("bigint").alias("batch_id"),
    )
    path = work_path(data.spark, "log")
    keyed = log.withColumns({"query_id": F.lit("daily"), "batch_id": F.dayofmonth(F.to_date("timestamp"))})
    keyed.write.partitionBy("query_id", "batch_id").json(path)
    return jobs.monitoring_metrics(jobs.read_events(data.spark, path))


@query("R4_stream_decision", f"""
SELECT event_id, user_id AS account_id, {r('value / 1000.0', 'fraud_probability')}, value / 1000.0 >= 0.05 AS is_high_risk,
 0.05::DOUBLE AS threshold_used, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey""")
def _(data):
    schema = "event_id bigint, user_id bigint, value double"
    stream = jobs.stream_files(data.spark, data.directory, schema, format="parquet", pattern="events.parquet")
    probability = (F.col("value") / 1000.0).alias("fraud_probability")
    segments = data.table("customer").select(F.col("c_custkey").alias("account_id"), "c_mktsegment")
    return jobs.score_stream(
        stream.select("event_id", F.col("user_id").alias("account_id"), probability),
        lambda rows: jobs.attach_attributes(scoring.decide(rows, 0.05), segments, "account_id"),
        work_path(data.spark, "decisions"),
        work_path(data.spark, "offsets"),
    )


@query("R4_online_scoring")
def _(data):
    folder = work_path(data.spark, "arrivals")
    data.tabular.write.parquet(folder)
    stream = jobs.stream_files(data.spark, folder, data.tabular.schema, format="parquet", files_per_trigger=None)
    attributes = data.nodes.select(F.col("node_id").alias("account_id"), "fraud_step")
    return jobs.score_stream(
        stream,
        lambda rows: jobs.attach_attributes(scoring.score_accounts(data.model, rows, 0.5), attributes, "account_id"),
        work_path(data.spark, "scores"),
        work_path(data.spark, "offsets"),
    )


@query("R4_online_history", "SELECT transaction_id, " + ", ".join(r(n, n) for n in USER_FEATURES) + " FROM event_history")
def _(data):
    """The events arrive in four parts, in step order; each is read as a batch of its own."""
    folder = work_path(data.spark, "arrivals")
    events = data.events.select("transaction_id", "source_account_id", "event_step", "amount")
    cuts = [None, *events.agg(F.percentile_approx("event_step", [0.25, 0.5, 0.75])).first()[0], None]
    for low, high in zip(cuts, cuts[1:]):
        part = events if low is None else events.where(F.col("event_step") > low)
        part = part if high is None else part.where(F.col("event_step") <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.stream_files(data.spark, folder, events.schema, format="parquet")
    rows = history.stream_history(
        stream, "source_account_id", "user", work_path(data.spark, "history"), work_path(data.spark, "offsets"), windows=WINDOWS
    )
    return rows.select("transaction_id", *USER_FEATURES)
