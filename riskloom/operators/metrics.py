"""Binary classification metrics over (label, score) frames, as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.columns import safe_divide
from riskloom.functions.ordered import running_totals

# The threshold grid 0.05, 0.10, ... 0.95
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def score_counts(scored: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score. ``rank_key`` ascends as the score falls."""
    positive = F.col(label) == 1
    return scored.groupBy((-F.col(score)).alias("rank_key")).agg(
        F.count_if(positive).alias("tp"), F.count_if(~positive).alias("fp")
    )


def ranking_curve(scored: DataFrame, *, label: str = "label", score: str = "score", levels: int = 2) -> DataFrame:
    """True and false positives accepted at every distinct score, highest score first."""
    counts = score_counts(scored, label=label, score=score)
    return running_totals(counts, [], "rank_key", ["tp", "fp"], levels=levels)


def ranking_metrics(scored: DataFrame, *, label: str = "label", score: str = "score") -> DataFrame:
    """average_precision = sum of (R_n - R_n-1) * P_n, and roc_auc with ties counted half.

    NULL where undefined: no positives, or only one class.
    """
    curve = ranking_curve(scored, label=label, score=score)
    precision = F.col("tp_upto") / (F.col("tp_upto") + F.col("fp_upto"))
    wins = F.col("fp") * (F.col("tp_upto") - F.col("tp") / 2.0)
    positives, negatives = F.sum("tp"), F.sum("fp")
    return curve.agg(
        F.try_divide(F.sum(F.col("tp") * precision), positives).alias("average_precision"),
        F.try_divide(F.sum(wins), (positives * negatives).cast("double")).alias("roc_auc"),
    )


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": safe_divide(tp.cast("double"), (tp + fp).cast("double")),
        "recall": safe_divide(tp.cast("double"), (tp + fn).cast("double")),
        "f1": safe_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")),
    }


def decision_metrics(scored: DataFrame, *, label: str = "label", decision: str = "prediction") -> DataFrame:
    positive, accepted = F.col(label) == 1, F.col(decision) == 1
    counts = scored.agg(
        F.count_if(positive & accepted).alias("tp"),
        F.count_if(~positive & accepted).alias("fp"),
        F.count_if(positive & ~accepted).alias("fn"),
        F.count("*").alias("rows"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select(*[c.alias(n) for n, c in rates.items()], "rows")


def threshold_metrics(
    scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *, label: str = "label", score: str = "score"
) -> DataFrame:
    """Confusion counts and rates per threshold.

    Rows are first counted by how many thresholds they pass, so the grid meets 20 rows, not the data.
    """
    grid = sorted(thresholds)
    passed = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    positive = F.col(label) == 1
    levels = scored.groupBy(passed.alias("passed")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    cells = levels.select(
        "passed", "pos", "neg", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("at", "threshold")
    )
    accepted = F.col("passed") > F.col("at")
    counts = cells.groupBy("threshold").agg(
        F.sum(F.when(accepted, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(accepted, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~accepted, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~accepted, F.col("neg")).otherwise(0)).alias("tn"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("threshold", "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in rates.items()])


def best_threshold(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS, **columns) -> DataFrame:
    """The threshold of best F1; the smallest one wins a tie. Empty for empty input."""
    ranked = threshold_metrics(scored, thresholds, **columns)
    return ranked.orderBy(F.desc("f1"), F.asc("threshold")).limit(1).select("threshold", "f1")


def comparison_table(tracks: dict[str, DataFrame], baseline: tuple[str, str]) -> DataFrame:
    """All (track, model) metric rows in one table, with the change against a baseline row."""
    from riskloom.operators.quality import union_all

    names = ["precision", "recall", "f1", "average_precision", "roc_auc"]
    rows = union_all([df.select(F.lit(t).alias("track"), "model", *names) for t, df in tracks.items()])
    chosen = rows.where((F.col("track") == baseline[0]) & (F.col("model") == baseline[1])).limit(1)
    reference = chosen.select(F.struct(*names)).scalar()
    compared = rows.withColumn("_base", reference)
    return compared.select(
        "track", "model", *names, *[(F.col(n) - F.col(f"_base.{n}")).alias(f"{n}_delta") for n in names]
    )
