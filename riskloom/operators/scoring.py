"""Account scores, lookups, attributions, critical transactions and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.columns import money_sum, safe_divide
from riskloom.functions.ordered import top_per_group
from riskloom.operators.models import Trained
from riskloom.session import materialise


def score_accounts(model: Trained, features: DataFrame, threshold: float, *, key: str = "node_id") -> DataFrame:
    return model.score(features).select(
        F.col(key).alias("account_id"),
        F.col("score").alias("fraud_probability"),
        (F.col("score") >= threshold).alias("is_high_risk"),
        F.lit(float(threshold)).alias("threshold_used"),
    )


def decide(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.withColumns(
        {"is_high_risk": F.col("fraud_probability") >= threshold, "threshold_used": F.lit(float(threshold))}
    )


def lookup(requested: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the requested accounts; unknown ids stay, with ``found`` false."""
    known = scores.withColumn("found", F.lit(True))
    return requested.join(known, "account_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def risk_queue(predictions: DataFrame, *, order: str, size: int = 8) -> DataFrame:
    """The latest prediction of each account, highest probability first."""
    latest = top_per_group(predictions, ["account_id"], [F.desc(order)], 1).drop("rank")
    return latest.orderBy(F.desc("fraud_probability"), "account_id").limit(size)


def linear_contributions(
    standardised: DataFrame, coefficients: dict[str, float], *, key: str = "account_id", k: int = 10
) -> DataFrame:
    """Top k features per account by coefficient * standardised value. Every row is cut to its own best k first, so that
    only those are sorted and shuffled, not one row per feature."""
    names = sorted(coefficients, key=str.encode)
    entries = [
        F.struct((F.col(c) * F.lit(float(coefficients[c]))).alias("contribution"), F.lit(-i), F.lit(c).alias("feature"))
        for i, c in enumerate(names)
    ]
    best = F.slice(F.sort_array(F.array(*entries), asc=False), 1, k)
    long = standardised.select(key, F.explode(best).alias("_best")).select(key, "_best.feature", "_best.contribution")
    return top_per_group(long, [key], [F.desc("contribution"), F.asc("feature")], k)


def model_contributions(model: Trained, features: DataFrame, *, key: str = "node_id", k: int = 10) -> DataFrame:
    """Attribution of a fitted linear model, for its numeric inputs."""
    names = model.preprocessor.numeric
    weights = model.model.coefficients.toArray()[: len(names)]
    scaled = model.preprocessor.transform(features).select(
        F.col(key).alias("account_id"), vector_to_array("_scaled").alias("values")
    )
    wide = scaled.select("account_id", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return linear_contributions(wide, dict(zip(names, weights)), k=k)


def standardise(df: DataFrame, columns: Sequence[str], *, fitted_on: DataFrame | None = None) -> DataFrame:
    """z-scores by the mean and population deviation of ``fitted_on``; a zero deviation counts as 1."""
    measures = []
    for c in columns:
        deviation = F.stddev_pop(c)
        measures += [F.avg(c).alias(f"{c}_mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_std")]
    stats = df if fitted_on is None else fitted_on
    fitted = stats.agg(*measures).select(F.struct("*")).scalar()
    return df.withColumn("_fit", fitted).withColumns(
        {c: (F.col(c) - F.col(f"_fit.{c}_mean")) / F.col(f"_fit.{c}_std") for c in columns}
    ).drop("_fit")


def incident_edges(edges: DataFrame) -> DataFrame:
    """Every typed edge once per account end it touches (a loop once)."""
    account_ends = (
        (F.lit("account->transfers->account"), ("source_id", "target_id")),
        (F.lit("account->buys_from->merchant"), ("source_id",)),
        (F.lit("merchant->rev_buys_from->account"), ("target_id",)),
    )
    ends = F.lit(None).cast("array<struct<account_id:string,counterparty:string>>")
    other = {"source_id": "target_id", "target_id": "source_id"}
    for relation, sides in account_ends:
        pairs = F.array_distinct(
            F.array(*[F.struct(F.col(s).alias("account_id"), F.col(other[s]).alias("counterparty")) for s in sides])
        )
        ends = F.when(F.col("relation") == relation, pairs).otherwise(ends)
    return edges.withColumn("_end", F.explode(ends)).select("*", "_end.*").drop("_end")


def critical_transactions(
    edges: DataFrame, risk: DataFrame, *, k: int = 10, accounts: DataFrame | None = None
) -> DataFrame:
    """Top k incident edges per account, or per account of ``accounts`` (account_id) if given.

    importance = share of the edge in the account's flow within its relation x risk of the
    counterparty (merchants: mean risk of their buyers). ``risk``: account_id (text), probability.
    """
    incident = incident_edges(edges)
    if accounts is not None:
        incident = incident.join(accounts.select("account_id"), "account_id", "left_semi")
    flow = incident.groupBy("account_id", "relation").agg(money_sum(F.col("amount")).cast("double").alias("_flow"))
    flow = materialise(flow, "flow")  # then the join on a hub's flow is a plain shuffle that can be split
    purchases = edges.where(F.col("relation") == "account->buys_from->merchant")
    merchant_risk = (
        purchases.groupBy(F.col("source_id").alias("account_id"), F.col("target_id").alias("counterparty"))
        .agg(F.count("*").alias("n"))
        .join(risk, "account_id")
        .groupBy("counterparty")
        .agg((F.sum(F.col("n") * F.col("probability")) / F.sum("n")).alias("_risk"))
    )
    counterparties = risk.select(
        F.col("account_id").alias("counterparty"), F.col("probability").alias("_risk")
    ).unionByName(merchant_risk)
    weighted = incident.join(flow, ["account_id", "relation"]).join(counterparties, "counterparty", "left")
    importance = safe_divide(F.col("amount"), F.col("_flow")) * F.coalesce("_risk", F.lit(0.0))
    ranked = weighted.withColumn("importance", importance).drop("_flow", "_risk", "counterparty")
    order = [F.desc("importance"), F.asc("relation"), F.asc("transaction_id")]
    return top_per_group(ranked, ["account_id"], order, k)


def walked_transactions(edges: DataFrame, ranks: DataFrame, *, k: int = 10) -> DataFrame:
    """Top k transfers per seed by the walks that pass along them: rank of the sender x share of the transfer in what
    it sends. ``ranks`` as ``local_pagerank`` gives them, ``edges`` the typed edges; only senders that were reached are
    looked at. Ties go to the smaller transaction."""
    transfers = edges.where(F.col("relation") == "account->transfers->account")
    senders = ranks.where("rank > 0").select(F.col("seed"), F.col("node_id").cast("string").alias("source_id"), "rank")
    reached = transfers.join(senders.select("source_id").distinct(), "source_id", "left_semi")
    flow = materialise(reached.groupBy("source_id").agg(money_sum(F.col("amount")).cast("double").alias("_flow")), "flow")
    passed = reached.join(flow, "source_id").join(senders.withColumnRenamed("rank", "_rank"), "source_id")
    importance = safe_divide(F.col("amount"), F.col("_flow")) * F.col("_rank")
    ranked = passed.withColumn("importance", importance).drop("_flow", "_rank")
    return top_per_group(ranked, ["seed"], [F.desc("importance"), F.asc("transaction_id")], k)


def account_reports(scores: DataFrame, contributions: DataFrame, edges: DataFrame) -> DataFrame:
    """(account, probability, top_features map, critical_transactions array); both lists hold <= k."""
    features = contributions.groupBy("account_id").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "feature", "contribution"))),
                lambda x: F.struct(x["feature"], x["contribution"]),
            )
        ).alias("top_features")
    )
    detail = ["rank", "relation", "source_id", "target_id", "transaction_id", "amount", "event_time", "importance"]
    transactions = edges.groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct(*detail))).alias("critical_transactions")
    )
    return (
        scores.select(F.col("account_id").cast("string").alias("account_id"), "fraud_probability")
        .join(features, "account_id", "left")
        .join(transactions, "account_id", "left")
    )


def riskiest(scores: DataFrame) -> DataFrame:
    """The account with the highest probability, ties to the smaller id: one row, stored. Restrict the inputs of
    its report to this account before ranking contributions and edges."""
    return materialise(scores.orderBy(F.desc("fraud_probability"), "account_id").limit(1), "riskiest")


def highest_risk_report(scores: DataFrame, contributions: DataFrame, edges: DataFrame) -> DataFrame:
    """The report of the single riskiest account."""
    top = riskiest(scores)
    key = top.select(F.col("account_id").cast("string").alias("account_id"))
    return account_reports(
        top, contributions.join(key, "account_id", "left_semi"), edges.join(key, "account_id", "left_semi")
    )


