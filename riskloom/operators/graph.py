"""Weighted directed graphs as (vertices, edges) frames, and their one-pass measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.functions.columns import money_sum
from riskloom.session import materialise


@dataclass(frozen=True)
class Graph:
    """vertices: node_id + attributes. edges: src, dst, edge_count, total_amount, first_time, last_time."""

    vertices: DataFrame
    edges: DataFrame


def weighted_edges(transactions: DataFrame, source: str, destination: str, amount: str, time: str) -> DataFrame:
    """One edge per ordered pair; rows with an absent or blank end are skipped."""

    def present(name: str):
        column = F.col(name)
        if isinstance(transactions.schema[name].dataType, T.StringType):
            return column.isNotNull() & (column != "")
        return column.isNotNull()

    return (
        transactions.where(present(source) & present(destination))
        .groupBy(F.col(source).alias("src"), F.col(destination).alias("dst"))
        .agg(
            F.count("*").alias("edge_count"),
            money_sum(F.col(amount)).cast("double").alias("total_amount"),
            F.min(time).alias("first_time"),
            F.max(time).alias("last_time"),
        )
    )


def endpoints(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return ends.distinct()


def build_graph(
    transactions: DataFrame,
    *,
    source: str,
    destination: str,
    amount: str,
    time: str,
    nodes: DataFrame | None = None,
    node_id: str | None = None,
    attributes: Sequence[str] = (),
) -> Graph:
    """Endpoints missing from ``nodes`` become vertices without attributes."""
    edges = weighted_edges(transactions, source, destination, amount, time)
    if nodes is None or node_id is None:
        return Graph(endpoints(edges), edges)
    known = nodes.select(F.col(node_id).alias("node_id"), *attributes)
    return Graph(known.join(endpoints(edges), "node_id", "full_outer"), edges)


def archive_graph(nodes: DataFrame, transactions: DataFrame) -> Graph:
    return build_graph(
        transactions,
        source="source_node_id",
        destination="target_node_id",
        amount="amount",
        time="event_time",
        nodes=nodes,
        node_id="node_id",
        attributes=["is_fraud", "initial_balance", "fraud_step"],
    )


def account_graph(tables: dict[str, DataFrame]) -> Graph:
    return build_graph(
        tables["transactions"],
        source="source_account_id",
        destination="destination_account_id",
        amount="amount",
        time="event_step",
        nodes=tables["accounts"],
        node_id="account_id",
        attributes=["party_id", "is_alerted", "initial_balance", "bank_id"],
    )


def degrees(graph: Graph) -> DataFrame:
    """In/out degree and amount-weighted degree; isolated vertices get zeros."""

    def side(key: str, name: str) -> DataFrame:
        return graph.edges.groupBy(F.col(key).alias("node_id")).agg(
            F.count("*").alias(f"{name}_degree"), F.sum("total_amount").alias(f"weighted_{name}_degree")
        )

    joined = graph.vertices.select("node_id").join(side("dst", "in"), "node_id", "left")
    joined = joined.join(side("src", "out"), "node_id", "left")
    return joined.select(
        "node_id",
        *[
            F.coalesce(c, F.lit(0).cast(t)).alias(c)
            for c, t in (
                ("in_degree", "bigint"),
                ("out_degree", "bigint"),
                ("weighted_in_degree", "double"),
                ("weighted_out_degree", "double"),
            )
        ],
    )


def undirected_edges(edges: DataFrame, weight: str = "edge_count") -> DataFrame:
    """Simple undirected projection (a < b) without loops; both directions' weights are added."""
    return (
        edges.where("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.sum(weight).alias("weight"))
    )


def clustering(graph: Graph) -> DataFrame:
    """Local clustering coefficient 2T / (d (d - 1)) on the simple undirected projection.

    Every edge is directed from its lower-degree end to its higher-degree end, which bounds the
    out-neighbourhood of any vertex, hub or not, by sqrt(2 * edges). Triangles are intersections of
    two such neighbourhoods along an edge, so only real triangles are emitted, never pairs of
    neighbours.
    """
    # stored, because all are read several times, and so that the joins on a hub are plain shuffles, which
    # adaptive execution splits
    pairs = materialise(undirected_edges(graph.edges).select("a", "b"), "pairs")
    both = pairs.select(F.col("a").alias("node_id")).union(pairs.select(F.col("b").alias("node_id")))
    degree = materialise(both.groupBy("node_id").agg(F.count("*").alias("d")), "degree")
    ranked = pairs.join(degree.select(F.col("node_id").alias("a"), F.col("d").alias("da")), "a").join(
        degree.select(F.col("node_id").alias("b"), F.col("d").alias("db")), "b"
    )
    a_first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    oriented = ranked.select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("low"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("high"),
    )
    oriented = materialise(oriented, "oriented")
    upper = materialise(oriented.groupBy("low").agg(F.collect_list("high").alias("neighbours")), "upper")
    low_side = upper.select("low", F.col("neighbours").alias("of_low"))
    high_side = upper.select(F.col("low").alias("high"), F.col("neighbours").alias("of_high"))
    closed = oriented.join(high_side, "high").join(low_side, "low")
    triangles = closed.select(
        "low", "high", F.array_intersect("of_low", "of_high").alias("third")
    ).where(F.size("third") > 0)
    per_edge = triangles.select(
        F.explode(F.array("low", "high")).alias("node_id"), F.size("third").cast("bigint").alias("t")
    )
    per_third = triangles.select(F.explode("third").alias("node_id"), F.lit(1).cast("bigint").alias("t"))
    counted = per_edge.unionByName(per_third).groupBy("node_id").agg(F.sum("t").alias("triangles"))
    joined = graph.vertices.select("node_id").join(degree, "node_id", "left").join(counted, "node_id", "left")
    possible = F.col("d") * (F.col("d") - 1)
    coefficient = F.when(F.col("d") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / possible).otherwise(0.0)
    return joined.select("node_id", coefficient.alias("clustering_coefficient"))


def graph_summary(graph: Graph, components: DataFrame, coefficients: DataFrame) -> DataFrame:
    """One row; ``components`` and ``coefficients`` are the per-node frames."""
    nodes = graph.vertices.agg(F.count("*")).scalar()
    links = graph.edges.agg(F.count("*")).scalar()
    sizes = components.groupBy("weak_component_id").agg(F.count("*").alias("n"))
    shape = sizes.agg(
        F.count("*").alias("weak_component_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_weak_component_size"),
    )
    average = coefficients.agg(F.coalesce(F.avg("clustering_coefficient"), F.lit(0.0))).scalar()
    counted = shape.withColumns({"node_count": nodes, "edge_count": links, "average_clustering": average})
    n, m = F.col("node_count"), F.col("edge_count")
    per_node = F.coalesce(F.try_divide(m, n), F.lit(0.0))
    return counted.select(
        "node_count",
        "edge_count",
        F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0)).alias("density"),
        per_node.alias("average_in_degree"),
        per_node.alias("average_out_degree"),
        "weak_component_count",
        "largest_weak_component_size",
        "average_clustering",
    )


def top_nodes(features: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """Empty when the metric is unknown."""
    if metric not in features.columns:
        return features.limit(0)
    return features.orderBy(F.desc(metric), "node_id").limit(k)


def in_degree_histogram(vertices: DataFrame, transfers: DataFrame, target: str = "target_node_id") -> DataFrame:
    """How many vertices have each in-degree, degree 0 included. Parallel transfers count."""
    incoming = transfers.groupBy(F.col(target).alias("node_id")).agg(F.count("*").alias("degree"))
    joined = vertices.select("node_id").join(incoming, "node_id", "left")
    return joined.groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count("*").alias("node_count"))


def neighbourhood_aggregation(
    features: DataFrame, transfers: DataFrame, columns: Sequence[str], *, source: str, target: str
) -> DataFrame:
    """mean / min / max / std of the in-neighbours' features, each unscaled, amplified by
    log(d + 1) / delta and attenuated by its inverse, where delta averages log(d + 1) over vertices."""
    edges = transfers.select(F.col(source).alias("src"), F.col(target).alias("node_id"))
    sent = edges.join(features.select(F.col("node_id").alias("src"), *columns), "src")
    statistics = []
    for c in columns:
        statistics += [
            F.avg(c).alias(f"{c}_mean"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.stddev_pop(c).alias(f"{c}_std"),
        ]
    received = sent.groupBy("node_id").agg(F.count("*").alias("in_degree"), *statistics)
    joined = features.select("node_id").join(received, "node_id", "left").fillna(0)
    log_degree = F.log(F.col("in_degree") + 1.0)
    delta = joined.agg(F.avg(log_degree)).scalar()
    scaled = joined.withColumn("_delta", delta).withColumn("_log", F.log(F.greatest("in_degree", F.lit(1)) + 1.0))
    names = [f"{c}_{s}" for c in columns for s in ("mean", "min", "max", "std")]
    amplify = F.coalesce(F.try_divide("_log", "_delta"), F.lit(0.0))
    attenuate = F.coalesce(F.try_divide("_delta", "_log"), F.lit(0.0))
    return scaled.select(
        "node_id",
        "in_degree",
        *[F.col(n).cast("double").alias(n) for n in names],
        *[(F.col(n) * amplify).alias(f"{n}_amplified") for n in names],
        *[(F.col(n) * attenuate).alias(f"{n}_attenuated") for n in names],
    )


RELATIONS = ("account->transfers->account", "account->buys_from->merchant", "merchant->rev_buys_from->account")


def typed_edges(
    accounts: DataFrame, merchants: DataFrame, transactions: DataFrame, merchant_links: DataFrame
) -> DataFrame:
    """The three relations as one frame with (amount, event_time, transaction_type_code).

    Edges whose ends do not resolve to a vertex are dropped. Ids are text: merchants are named.
    """
    for frame, what in (
        (accounts, "accounts"),
        (merchants, "merchants"),
        (transactions, "transfers"),
        (merchant_links, "merchant links"),
    ):
        if frame.isEmpty():
            raise ValueError(f"typed edges need {what}, and there are none")
    attributes = ["transaction_id", "amount", "event_time", "transaction_type_code"]
    known = accounts.select("node_id")
    transfers = transactions.join(known.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    transfers = transfers.join(known.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")
    purchases = merchant_links.join(
        known.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi"
    ).join(merchants.select("merchant_id"), "merchant_id", "left_semi")
    account = F.col("source_node_id").cast("string")
    merchant = F.col("merchant_id")

    def relation(frame: DataFrame, name: str, source, target) -> DataFrame:
        return frame.select(
            F.lit(name).alias("relation"), source.alias("source_id"), target.alias("target_id"), *attributes
        )

    return (
        relation(transfers, RELATIONS[0], account, F.col("target_node_id").cast("string"))
        .unionByName(relation(purchases, RELATIONS[1], account, merchant))
        .unionByName(relation(purchases, RELATIONS[2], merchant, account))
    )
