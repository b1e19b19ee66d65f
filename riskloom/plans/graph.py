"""Graph node features and the feature bundle over an archive graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import fill_numbers
from riskloom.operators import flows, graph as graphs, iterative
from riskloom.operators.graph import Graph
from riskloom.session import materialise
from riskloom.settings import Settings

GRAPH_COLUMNS = (
    "in_degree",
    "out_degree",
    "weighted_in_degree",
    "weighted_out_degree",
    "pagerank",
    "clustering_coefficient",
    "weak_component_id",
    "weak_component_size",
    "community_id",
    "community_size",
)


def node_features(graph: Graph, *, settings: Settings = Settings()) -> DataFrame:
    """Ten graph measures plus the vertex attributes, one row per vertex."""
    pieces = [
        graphs.degrees(graph),
        iterative.pagerank(graph, damping=settings.graph.damping),
        graphs.clustering(graph),
        iterative.connected_components(graph),
    ]
    if settings.graph.communities:
        pieces.append(iterative.communities(graph, seed=settings.graph.community_seed))
    joined = graph.vertices
    for piece in pieces:
        joined = joined.join(piece, "node_id", "left")
    if not settings.graph.communities:
        joined = joined.withColumns({"community_id": F.lit(-1), "community_size": F.lit(0)})
    attributes = [c for c in graph.vertices.columns if c != "node_id"]
    return joined.select("node_id", *GRAPH_COLUMNS, *attributes)


def feature_bundle(
    nodes: DataFrame,
    transactions: DataFrame,
    *,
    settings: Settings = Settings(),
    include_embeddings: bool = True,
    id_column: str | None = None,
) -> dict[str, DataFrame | Graph]:
    """Archive inputs -> graph, account, merchant, node and embedding features.

    Shared inputs are written once at the stage boundary; every later step scans only its columns.
    """
    windows = settings.temporal.windows
    bucket = {"seed": settings.enrichment.seed, "pool_size": settings.enrichment.merchant_pool_size}
    clean_nodes = materialise(flows.archive_nodes(nodes), "nodes")
    clean = materialise(flows.archive_transactions(transactions, clean_nodes, id_column=id_column), "transfers")
    pairs = materialise(flows.pair_totals(clean, windows), "pairs")
    tabular = flows.merchant_interactions(flows.account_flows(clean_nodes, pairs, windows), pairs, **bucket)
    tabular = materialise(tabular, "tabular")

    edges = pairs.select(
        F.col("source_node_id").alias("src"),
        F.col("target_node_id").alias("dst"),
        F.col("n").alias("edge_count"),
        F.col("a").cast("double").alias("total_amount"),
        "first_time",
        "last_time",
    )
    graph = Graph(clean_nodes, edges)
    measured = node_features(graph, settings=settings)
    temporal = [c for c in tabular.columns if c not in clean_nodes.columns]
    features = fill_numbers(measured.join(tabular.select("node_id", *temporal), "node_id", "left"))
    features = materialise(features, "node_features")
    bundle: dict[str, DataFrame | Graph] = {
        "graph": graph,
        "normalized_nodes": clean_nodes,
        "normalized_transactions": clean,
        "tabular_account_features": tabular,
        "node_features": features,
        "merchant_features": flows.merchant_features(pairs, windows, **bucket),
        "merchant_links": flows.archive_merchant_links(clean, **bucket),
    }
    if include_embeddings:
        embeddings = iterative.spectral_embedding(
            graph, dimensions=settings.graph.embedding_dimensions, seed=settings.graph.embedding_seed
        )
        bundle["embeddings"] = embeddings
        bundle["combined"] = features.join(embeddings, "node_id", "left")
    else:
        bundle["combined"] = features
    return bundle


def graph_bundle(graph: Graph, *, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Features, embeddings and their join for a graph that is already built."""
    features = materialise(node_features(graph, settings=settings), "node_features")
    embeddings = iterative.spectral_embedding(
        graph, dimensions=settings.graph.embedding_dimensions, seed=settings.graph.embedding_seed
    )
    return {
        "node_features": features,
        "embeddings": embeddings,
        "combined": features.join(embeddings, "node_id", "left"),
    }


def model_columns(features: DataFrame, ids: Sequence[str] = ("node_id", "is_fraud", "fraud_step")) -> list[str]:
    return [c for c in features.columns if c not in ids]
