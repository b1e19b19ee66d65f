"""Per-session access to a data directory: lazily built, stage boundaries stored once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskloom.operators import drift, features, flows, graph as graphs, models, scoring, trailing
from riskloom.plans import canonical, domain, graph as graph_plans
from riskloom.session import materialise
from riskloom.settings import ModelJob, Settings

WINDOWS = (1, 7, 30)
_open: dict[tuple[str, str], "RiskData"] = {}


def open_data(spark: SparkSession, directory: str) -> "RiskData":
    key = (spark.sparkContext.applicationId, directory)
    if key not in _open:
        _open[key] = RiskData(spark, directory)
    return _open[key]


class RiskData:
    """Canonical tables are written once and read by all feature and report jobs, as a warehouse
    would hold them; every property below is such a stage boundary."""

    def __init__(self, spark: SparkSession, directory: str, settings: Settings = Settings()):
        self.spark, self.directory, self.settings = spark, directory, settings

    def table(self, name: str) -> DataFrame:
        return domain.table(self.spark, self.directory, name)

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return domain.raw_tables(self.spark, self.directory)

    @cached_property
    def fresh(self) -> canonical.LazyTables:
        """Canonical tables as the library call gives them: stored boundaries, and plans over them."""
        return canonical.canonical_tables(self.raw, domain.LAYOUT, self.settings.enrichment)

    @cached_property
    def tables(self) -> canonical.LazyTables:
        fresh = self.fresh
        return canonical.LazyTables(tuple(fresh), lambda n: fresh[n] if n in canonical.STORED else materialise(fresh[n], n))

    @cached_property
    def feature_sets(self) -> dict[str, DataFrame]:
        return features.feature_sets(self.tables, windows=WINDOWS)

    @cached_property
    def transactions(self) -> DataFrame:
        return self.tables["transactions"]

    @cached_property
    def events(self) -> DataFrame:
        return domain.event_stream(self.table("events"))

    @cached_property
    def history(self) -> DataFrame:
        return materialise(trailing.transaction_history(self.transactions, windows=WINDOWS), "history")

    @cached_property
    def transaction_features(self) -> DataFrame:
        return materialise(self.feature_sets["transaction"], "transaction_features")

    @cached_property
    def party_features(self) -> DataFrame:
        return materialise(self.feature_sets["party"], "party_features")

    @cached_property
    def archive(self) -> dict[str, DataFrame]:
        return domain.archive_tables(self.spark, self.directory)

    @cached_property
    def nodes(self) -> DataFrame:
        return materialise(flows.archive_nodes(self.archive["nodes"]), "nodes")

    @cached_property
    def transfers(self) -> DataFrame:
        rows = flows.archive_transactions(self.archive["transactions"], self.nodes, id_column="id")
        return materialise(rows, "transfers")

    @cached_property
    def pairs(self) -> DataFrame:
        return materialise(flows.pair_totals(self.transfers, WINDOWS), "pairs")

    @cached_property
    def graph(self) -> graphs.Graph:
        built = graphs.archive_graph(self.nodes, self.transfers)
        return graphs.Graph(materialise(built.vertices, "vertices"), materialise(built.edges, "edges"))

    @cached_property
    def tabular(self) -> DataFrame:
        flow = flows.account_flows(self.nodes, self.pairs, WINDOWS)
        return materialise(flows.merchant_interactions(flow, self.pairs), "tabular")

    @cached_property
    def merchants(self) -> DataFrame:
        return materialise(flows.merchant_features(self.pairs, WINDOWS), "merchants")

    @cached_property
    def merchant_links(self) -> DataFrame:
        return flows.archive_merchant_links(self.transfers)

    @cached_property
    def typed_edges(self) -> DataFrame:
        return graphs.typed_edges(self.nodes, self.merchants, self.transfers, self.merchant_links)

    @cached_property
    def bundle(self) -> dict:
        """The graph feature bundle of the archive, stored."""
        archive = self.archive
        built = graph_plans.feature_bundle(
            archive["nodes"], archive["transactions"], settings=self.settings, id_column="id"
        )
        return built | {n: materialise(built[n], n) for n in ("embeddings", "combined")}

    @cached_property
    def tracks(self) -> dict[str, DataFrame]:
        """Test metrics of all six model tracks, by the models of the settings: trained once, shared by the queries."""
        job = self.settings.model
        # the balance defines the label of the derived domain tables
        bundle = {n: df.drop("initial_balance") for n, df in self.bundle.items() if isinstance(df, DataFrame)}
        rows = {
            "transaction": models.train_transaction_model(self.transaction_features, settings=job),
            "party": models.train_party_model(self.party_features.drop("alert_count"), settings=job),
            "account_tabular": models.train_node_model(bundle["tabular_account_features"], settings=job),
            "graph_node": models.train_node_model(bundle["node_features"], settings=job),
            "embedding_only": models.train_embedding_model(bundle["embeddings"], self.nodes, settings=job),
            "combined": models.train_node_model(bundle["combined"], settings=job),
        }
        return {n: materialise(df, n) for n, df in rows.items()}

    @cached_property
    def model(self) -> models.Trained:
        """Logistic regression on the account-tabular features."""
        columns = graph_plans.model_columns(self.tabular)
        frame = self.tabular.withColumn("label", F.col("is_fraud").cast("double"))
        # the balance defines the label of the derived domain tables
        return models.fit(frame, [c for c in columns if c != "initial_balance"], "node_id", settings=ModelJob())

    @cached_property
    def forest(self) -> models.Trained:
        """A random forest of the settings on the same columns."""
        columns = [c for c in graph_plans.model_columns(self.tabular) if c != "initial_balance"]
        frame = self.tabular.withColumn("label", F.col("is_fraud").cast("double"))
        return models.fit(frame, columns, "node_id", kind="random_forest", settings=self.settings.model)

    @cached_property
    def scores(self) -> DataFrame:
        return materialise(scoring.score_accounts(self.model, self.tabular, 0.5), "scores")

    @cached_property
    def drift_pair(self) -> tuple[DataFrame, DataFrame]:
        """Account features, and the same with a five-fold surge in two of them."""
        surged = ("outgoing_tx_velocity_30d", "total_amount")
        return self.tabular, drift.perturbed(self.tabular, surged, 5.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(
        [
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )
