"""Cohorts, two-sample Kolmogorov-Smirnov drift and activity summaries.

All features of a frame are tested in one job: they are melted to (feature, value), collapsed to value
counts, and the empirical distribution functions are prefix sums over those counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.functions.columns import money_sum, numeric_columns, relative_change, safe_divide
from riskloom.functions.ordered import running_totals
from riskloom.session import materialise

# Identifiers, labels and times are not features
NOT_FEATURES = (
    "node_id",
    "is_fraud",
    "fraud_step",
    "transaction_id",
    "source_account_id",
    "destination_account_id",
    "source_node_id",
    "target_node_id",
    "event_step",
    "event_time",
    "transaction_type",
    "label_source",
)
# Fixed values
TEMPORAL_TOKENS = ("prev_", "recent_", "gap", "velocity_ratio", "amount_ratio")
# Identifying text columns of the transaction features
TEXT_COLUMNS = ("transaction_id", "source_account_id", "destination_account_id", "transaction_type", "label_source")
STRONG_DRIFT = 0.2
# terms of either form of the Kolmogorov series; both converge to 1e-15 with them on their side of SERIES_CUT
SERIES_TERMS, SERIES_CUT = 8, 1.18


def temporal_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TEXT_COLUMNS and any(token in c for token in TEMPORAL_TOKENS)]


def distribution_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c not in NOT_FEATURES]


def with_cohort(
    df: DataFrame, *, step: str = "event_step", baseline_window: int = 30, recent_window: int = 7
) -> DataFrame:
    """Adds ``cohort`` and ``_bounds``. Recent: the last ``recent_window`` steps. Baseline: the steps
    before them, or every earlier row when those steps are empty."""
    extent = df.agg(F.struct(F.min(step).alias("lo"), F.max(step).alias("hi"))).scalar()
    position = F.col(step)
    bounded = df.withColumn("_extent", extent)
    start = F.col("_extent.hi") - recent_window + 1
    base_start = F.greatest(F.col("_extent.lo"), start - baseline_window)
    regular = (position < start) & (position >= base_start)
    usable = bounded.agg(F.coalesce(F.bool_or(regular), F.lit(False))).scalar()
    cohort = F.when(position >= start, "recent").when(
        (position < start) & (regular | ~F.col("_usable")), "baseline"
    )
    bounds = F.struct(
        F.col("_extent.lo").alias("min_step"),
        F.col("_extent.hi").alias("max_step"),
        base_start.alias("baseline_start"),
        (start - 1).alias("baseline_end"),
        start.alias("recent_start"),
        F.col("_extent.hi").alias("recent_end"),
    )
    labelled = bounded.withColumn("_usable", usable).withColumn("cohort", cohort).withColumn("_bounds", bounds)
    return labelled.drop("_extent", "_usable")


def cohort_summary(df: DataFrame, **options) -> DataFrame:
    cohorts = with_cohort(df, **options)
    return cohorts.groupBy("_bounds").agg(
        F.count_if(F.col("cohort") == "baseline").alias("baseline_rows"),
        F.count_if(F.col("cohort") == "recent").alias("recent_rows"),
    ).select("_bounds.*", "baseline_rows", "recent_rows")


def melted(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ("cohort",)) -> DataFrame:
    """(ids, feature, value) without missing values; every feature in one frame."""
    typed = df.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in columns])
    long = typed.unpivot(list(ids), list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(cohorts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature and distinct value, the rows of each cohort."""
    long = melted(cohorts.where(F.col("cohort").isNotNull()), columns)
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("cohort") == "baseline").alias("baseline"),
        F.count_if(F.col("cohort") == "recent").alias("recent"),
    )


def distribution_steps(cohorts: DataFrame, columns: Sequence[str], *, levels: int = 2) -> DataFrame:
    """Cumulative counts of both cohorts at every distinct value."""
    return running_totals(
        value_counts(cohorts, columns), ["feature"], "value", ["baseline", "recent"], levels=levels
    )


def feature_drift(cohorts: DataFrame, columns: Sequence[str], *, levels: int = 2) -> DataFrame:
    """Means, deltas and the KS statistic per feature; features missing in a cohort are left out."""
    return drift_of_counts(materialise(value_counts(cohorts, columns), "counts"), levels=levels)


def drift_of_counts(counts: DataFrame, *, levels: int = 2) -> DataFrame:
    """The same from stored value counts (feature, value, baseline, recent)."""
    weighted = [
        (F.sum(F.col("value") * F.col(side)) / F.nullif(F.sum(side), F.lit(0))).alias(f"{side}_mean")
        for side in ("baseline", "recent")
    ]
    totals = counts.groupBy("feature").agg(
        F.sum("baseline").alias("baseline_rows"), F.sum("recent").alias("recent_rows"), *weighted
    )
    totals = totals.where("baseline_rows > 0 and recent_rows > 0")
    steps = running_totals(counts, ["feature"], "value", ["baseline", "recent"], levels=levels, stored=True)
    gap = F.abs(F.col("baseline_upto") / F.col("baseline_rows") - F.col("recent_upto") / F.col("recent_rows"))
    statistics = steps.join(totals.select("feature", "baseline_rows", "recent_rows"), "feature")
    statistics = statistics.groupBy("feature").agg(F.max(gap).alias("ks_statistic"))
    return totals.join(statistics, "feature").select(
        "feature",
        "baseline_mean",
        "recent_mean",
        (F.col("recent_mean") - F.col("baseline_mean")).alias("mean_delta"),
        relative_change(F.col("baseline_mean"), F.col("recent_mean")).alias("relative_change"),
        "ks_statistic",
        "baseline_rows",
        "recent_rows",
    )


# of two samples up to this size, the p-value is exact by default
EXACT_ROWS = 10_000


def _pvalue_function():
    # nested, so that executors get the function itself and need no import of this package

    def exact_ks_pvalue(statistic: float, n: int, m: int) -> float:
        """Exact two-sided two-sample p-value: the chance that a random lattice path from (0, 0) to (n, m) leaves
        the band of width ``statistic``, followed diagonal by diagonal. Only the cells inside the band are held, and
        the chances of leaving it are added up, so small values keep their digits. Takes n + m steps; samples of one
        size have a closed form, a series of few terms."""
        if statistic <= 0:
            return 1.0
        long, short = max(n, m), min(n, m)
        if long == short:
            # equal sizes: the paths that leave the band, by reflections at its edges
            edge, total, k = max(1, round(statistic * long)), 0.0, 1
            while k * edge <= long:
                j = np.arange(1, k * edge + 1, dtype=np.float64)
                # C(2n, n - k * edge) / C(2n, n)
                term = float(np.exp(np.log1p(-k * edge / (long + j)).sum()))
                total += term if k % 2 else -term
                if term <= 1e-18 * abs(total):
                    break
                k += 1
            return float(min(1.0, max(0.0, 2.0 * total)))
        scale = math.lcm(long, short)
        edge, across, up = round(statistic * scale), scale // long, scale // short
        # Draw the merged sample in random order. After s draws, j of them are from the shorter side; stay[j - low] is
        # the chance to be there without having left the band.
        low, stay, left = 0, np.ones(1), 0.0
        for s in range(1, long + short + 1):
            j = np.arange(low, low + len(stay) + 1)
            moved = np.zeros(len(j))
            moved[:-1] = stay * (long - (s - 1 - j[:-1]))
            moved[1:] += stay * (short - j[:-1])
            moved /= long + short - s + 1
            inside = np.flatnonzero(np.abs((s - j) * across - j * up) < edge)
            if not len(inside):
                return float(min(1.0, left + moved.sum()))
            first, last = inside[0], inside[-1] + 1
            left += moved[:first].sum() + moved[last:].sum()
            low, stay = low + int(first), moved[first:last]
        return float(min(1.0, left))

    return exact_ks_pvalue


exact_ks_pvalue = _pvalue_function()


def asymptotic_ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Kolmogorov's limit with Stephens' small-sample correction. Small arguments take the theta form of the series:
    the alternating form does not converge there."""
    size = n.cast("double") * m.cast("double") / (n.cast("double") + m.cast("double"))
    root = F.sqrt(size)
    scaled = (root + 0.12 + 0.11 / root) * statistic
    large = sum((F.exp(-2.0 * k * k * scaled * scaled) * (2.0 * (-1) ** (k - 1)) for k in range(1, SERIES_TERMS + 1)), F.lit(0.0))
    odd = [2 * k - 1 for k in range(1, SERIES_TERMS + 1)]
    small = sum((F.exp(F.lit(-(k * math.pi) ** 2 / 8.0) / (scaled * scaled)) for k in odd), F.lit(0.0))
    below = 1.0 - small * math.sqrt(2.0 * math.pi) / scaled
    p = F.when(scaled <= 0, 1.0).when(scaled < SERIES_CUT, below).otherwise(large)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def with_pvalue(drift: DataFrame, *, method: str = "asymptotic") -> DataFrame:
    """Adds ``ks_pvalue``. ``asymptotic`` is a column expression and right to a few per cent from some dozen rows a
    side on; ``exact`` takes one step a row, in one Python call a feature; ``auto`` is exact where neither side has
    over EXACT_ROWS rows, as statistics libraries do."""
    p = asymptotic_ks_pvalue(F.col("ks_statistic"), F.col("baseline_rows"), F.col("recent_rows"))
    if method == "asymptotic":
        return drift.withColumn("ks_pvalue", p)
    if method not in ("exact", "auto"):
        raise ValueError(f"unknown p-value method {method!r}: asymptotic, exact or auto")
    most = EXACT_ROWS if method == "auto" else None

    def per_feature(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        rows = zip(statistic, n, m)
        values = [exact_ks_pvalue(d, int(a), int(b)) if most is None or max(a, b) <= most else None for d, a, b in rows]
        return pd.Series(values, dtype="float64")

    exact = F.pandas_udf(per_feature, "double")("ks_statistic", "baseline_rows", "recent_rows")
    return drift.withColumn("ks_pvalue", exact if most is None else F.coalesce(exact, p))


def drift_order() -> list[Column]:
    return [F.desc("ks_statistic"), F.desc(F.abs("mean_delta")), F.asc("feature")]


def temporal_drift(
    features: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    step: str = "event_step",
    baseline_window: int = 30,
    recent_window: int = 7,
) -> DataFrame:
    cohorts = with_cohort(features, step=step, baseline_window=baseline_window, recent_window=recent_window)
    return feature_drift(cohorts, columns or temporal_feature_columns(features))


def temporal_drift_report(
    features: DataFrame, *, top_k: int = 10, method: str = "auto", **options
) -> DataFrame:
    """Ranked features with p-values; ``in_top`` and ``strong`` mark the two lists of the report. The frame has one
    row per feature, so ranking it in one task is bounded by the number of columns."""
    drift = with_pvalue(temporal_drift(features, **options), method=method)
    place = F.row_number().over(W.orderBy(*drift_order()))
    return drift.select(
        "*", (place <= top_k).alias("in_top"), (F.col("ks_statistic") >= STRONG_DRIFT).alias("strong")
    )


def comparable_columns(baseline: DataFrame, recent: DataFrame, columns: Sequence[str] | None) -> list[str]:
    usable = set(distribution_feature_columns(recent))
    wanted = columns or distribution_feature_columns(baseline)
    names = [c for c in wanted if c in baseline.columns and c in usable]
    if not names:
        raise ValueError("the two frames have no overlapping numeric feature columns")
    return names


def distribution_drift(
    baseline: DataFrame,
    recent: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    ks_threshold: float = STRONG_DRIFT,
    pvalue_threshold: float = 0.05,
    method: str = "auto",
) -> DataFrame:
    """Per feature drift between two frames, with the verdict ``drifted``: a KS statistic of ``ks_threshold`` or more
    and a p-value of ``pvalue_threshold`` or less."""
    for frame, what in ((baseline, "Baseline"), (recent, "Recent")):
        if frame.isEmpty():
            raise ValueError(f"{what} frame has no rows to compare")
    names = comparable_columns(baseline, recent, columns)
    doubles = [F.col(c).try_cast("double").alias(c) for c in names]
    cohorts = baseline.select(*doubles, F.lit("baseline").alias("cohort")).unionByName(
        recent.select(*doubles, F.lit("recent").alias("cohort"))
    )
    return with_verdict(feature_drift(cohorts, names), ks_threshold, pvalue_threshold, method)


def with_verdict(
    drift: DataFrame, ks_threshold: float = STRONG_DRIFT, pvalue_threshold: float = 0.05, method: str = "asymptotic"
) -> DataFrame:
    significant = (F.col("ks_statistic") >= ks_threshold) & (F.col("ks_pvalue") <= pvalue_threshold)
    return with_pvalue(drift, method=method).withColumn("drifted", significant)


def drift_verdict(drift: DataFrame) -> DataFrame:
    """The one-row summary of a distribution drift frame."""
    drifted = F.col("drifted")
    return drift.agg(
        F.count("*").alias("feature_count_analyzed"),
        F.coalesce(F.bool_or(drifted), F.lit(False)).alias("drift_detected"),
        F.max("ks_statistic").alias("drift_score"),
        # bounded by the number of feature columns
        F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_features"),
        F.max("baseline_rows").alias("baseline_rows"),
        F.max("recent_rows").alias("recent_rows"),
    )


def perturbed(df: DataFrame, columns: Sequence[str], factor: float, *, sample_size: int | None = None) -> DataFrame:
    """Scale some features: a synthetic surge to test the detector with."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns to perturb: {', '.join(missing)}")
    sample = df.limit(sample_size) if sample_size else df
    return sample.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * factor for c in columns})


def activity_by_step(transactions: DataFrame) -> DataFrame:
    grouped = transactions.groupBy("event_step").agg(
        F.count("*").alias("transaction_count"),
        F.count_if("is_alert_related").alias("alert_related_count"),
        F.count_if("is_cash").alias("cash_count"),
        money_sum(F.col("amount")).cast("double").alias("amount_total"),
    )
    return grouped.withColumns(
        {
            "alert_related_rate": safe_divide(F.col("alert_related_count"), F.col("transaction_count")),
            "cash_rate": safe_divide(F.col("cash_count"), F.col("transaction_count")),
        }
    )


def recent_scorecard(transactions: DataFrame, windows: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """One row: step range, totals, and per window transactions, amount and alert-related rows."""
    latest = transactions.agg(F.max("event_step")).scalar()
    measures = [
        F.min("event_step").alias("min_step"),
        F.max("event_step").alias("max_step"),
        F.count("*").alias("transaction_count"),
    ]
    for w in windows:
        inside = F.col("event_step") >= F.col("_latest") - w + 1
        amount = F.coalesce(money_sum(F.when(inside, F.col("amount"))), F.lit(0))
        measures += [
            F.count_if(inside).alias(f"transactions_recent_{w}"),
            amount.cast("double").alias(f"amount_recent_{w}"),
            F.count_if(inside & F.col("is_alert_related")).alias(f"alert_related_recent_{w}"),
        ]
    return transactions.withColumn("_latest", latest).agg(*measures)


def activity_summary(
    tables: dict[str, DataFrame], feature_sets: dict[str, DataFrame], windows: Sequence[int] = (1, 7, 30), top_k: int = 10
) -> dict[str, DataFrame]:
    longest = max(windows)
    ratio = f"source_account_velocity_ratio_1_to_{longest}"
    recent = f"outgoing_count_recent_{longest}"
    parties = feature_sets["party"].select("party_id", recent, f"outgoing_amount_recent_{longest}", "label")
    velocity = feature_sets["transaction"].select(
        "transaction_id", "source_account_id", ratio, "source_account_count_prev_7", "label"
    )
    return {
        "activity_by_step": activity_by_step(tables["transactions"]),
        "recent_window_stats": recent_scorecard(tables["transactions"], windows),
        "party_count": tables["parties"].agg(F.count("*").alias("party_count")),
        "top_parties_by_recent_outgoing_activity": parties.orderBy(F.desc(recent), "party_id").limit(top_k),
        "top_transactions_by_velocity": velocity.orderBy(F.desc(ratio), "transaction_id").limit(top_k),
    }
