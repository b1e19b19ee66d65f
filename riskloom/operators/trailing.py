"""Trailing-window history of each event, per entity.

For an event at step ``s`` the window ``w`` covers the entity's events that come strictly before it in
(step, id) order and have ``step >= s - w``. The id range is cut into at most 2**20 slices, and the
count splits into three parts:

* rows before it in its own (entity, step, slice): a window over one slice;
* earlier slices of the same step: a ROWS frame over the (entity, step, slice) totals of one step, at most
  2**20 rows;
* earlier steps in [s - w, s - 1]: RANGE frames over the (entity, step) totals, as many rows per entity as
  it has steps.

So a hot entity, or a burst of one entity inside one step, is spread over many tasks, and no task
receives all events of an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from riskloom.functions.columns import money, money_sum, safe_divide
from riskloom.settings import checked_windows

MAX_SLICES = 2**20
MIN_SLICE_WIDTH = 2**20
CODE_BYTES = 7


def _text_code(text: Column, skip: Column) -> Column:
    """Order-preserving number from the bytes that follow the common prefix of all ids."""
    digits = F.substring(F.hex(F.substring(text, skip + 1, CODE_BYTES)), 1, 2 * CODE_BYTES)
    return F.conv(F.rpad(digits, 2 * CODE_BYTES, "0"), 16, 10).cast("bigint")


def _id_slices(base: DataFrame, id_column: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``_code`` (typed order of the id) and ``_slice`` (monotone in the code).

    Ids order as numbers when every id is a number, else as text.
    """
    identifier = F.col(id_column)
    if isinstance(base.schema[id_column].dataType, T.IntegralType):
        bounds = base.agg(F.min(identifier).cast("bigint").alias("lo"), F.max(identifier).cast("bigint").alias("hi"))
        code = identifier.cast("bigint")
        extra: list[Column] = []
    else:
        number = identifier.try_cast("bigint")
        bounds = base.agg(
            F.bool_and(number.isNotNull()).alias("numeric"),
            F.min(number).alias("lo_number"),
            F.max(number).alias("hi_number"),
            F.min(identifier).alias("lo_text"),
            F.max(identifier).alias("hi_text"),
        )
        shared = F.filter(
            F.sequence(F.lit(1), F.greatest(F.length("lo_text"), F.lit(1))),
            lambda i: F.substring(F.col("lo_text"), F.lit(1), i) == F.substring(F.col("hi_text"), F.lit(1), i),
        )
        bounds = bounds.withColumn("skip", F.size(shared))
        bounds = bounds.select(
            "numeric",
            "skip",
            *[
                F.when(F.col("numeric"), F.col(f"{end}_number"))
                .otherwise(_text_code(F.col(f"{end}_text"), F.col("skip")))
                .alias(end)
                for end in ("lo", "hi")
            ],
        )
        code = F.when(F.col("_ids.numeric"), number).otherwise(_text_code(identifier, F.col("_ids.skip")))
        extra = [F.col("numeric"), F.col("skip")]
    # halves: the distance of two 64-bit ids does not fit into 64 bits
    span = F.shiftright("hi", 1) - F.shiftright("lo", 1)
    width = F.greatest(F.lit(MIN_SLICE_WIDTH // 2), F.floor(span / MAX_SLICES) + 1).cast("bigint")
    stats = bounds.select(F.struct("lo", width.alias("width"), *extra).alias("ids")).scalar()

    def add(df: DataFrame) -> DataFrame:
        coded = df.withColumn("_ids", stats).withColumn("_code", code)
        return coded.withColumn("_slice", F.expr("(shiftright(_code, 1) - shiftright(_ids.lo, 1)) div _ids.width")).drop("_ids")

    return add


def feature_names(prefix: str, windows: Sequence[int]) -> list[str]:
    windows = checked_windows(windows)
    names = [f"{prefix}_previous_gap"]
    for w in windows:
        names += [f"{prefix}_count_prev_{w}", f"{prefix}_amount_prev_{w}"]
    return [*names, f"{prefix}_velocity_ratio_1_to_{windows[-1]}", f"{prefix}_amount_ratio_1_to_{windows[-1]}"]


def add_trailing_history(
    events: DataFrame,
    entity: str,
    prefix: str,
    *,
    windows: Sequence[int] = (1, 7, 30),
    step: str = "event_step",
    amount: str = "amount",
    ids: Sequence[str] = ("transaction_id", "is_cash"),
    base: DataFrame | None = None,
) -> DataFrame:
    """``events`` plus gap, counts, amounts and ratios per window. Rows without an entity get zeros.

    ``base`` holds the same events without columns added since; the history is aggregated from it, so
    chained calls do not recompute each other.
    """
    windows = checked_windows(windows)
    base = base or events
    add_slices = _id_slices(base, ids[0])

    slices = (
        # rows without a step join nothing below; both reads of the exchange ask for the same rows
        add_slices(base.select(entity, step, ids[0], amount).where(F.col(entity).isNotNull() & F.col(step).isNotNull()))
        .groupBy(entity, step, "_slice")
        .agg(F.count("*").alias("_n"), money_sum(F.col(amount)).alias("_a"))
        # one exchange feeds the frames inside a step and the totals of the steps
        .repartition(entity, step)
    )
    same_step = W.partitionBy(entity, step).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    earlier_slices = slices.select(
        entity,
        step,
        "_slice",
        F.coalesce(F.sum("_n").over(same_step), F.lit(0)).alias("_n_slices"),
        F.coalesce(F.sum("_a").over(same_step), F.lit(0)).alias("_a_slices"),
    )
    # (no slice comes before the first; saying so keeps the columns of both reads of the exchange equal, so it is shared)
    steps = slices.groupBy(entity, step).agg(
        F.min("_slice").alias("_first"), F.sum("_n").alias("_n"), F.sum("_a").alias("_a")
    )
    timeline = W.partitionBy(entity).orderBy(step)
    measures = [F.max(step).over(timeline.rangeBetween(W.unboundedPreceding, -1)).alias("_prev_step")]
    for w in windows:
        frame = timeline.rangeBetween(-w, -1)
        measures += [F.sum("_n").over(frame).alias(f"_n_{w}"), F.sum("_a").over(frame).alias(f"_a_{w}")]
    history = earlier_slices.join(steps.select(entity, step, "_first", *measures), [entity, step])
    history = history.where("_slice >= _first").drop("_first")

    inside = W.partitionBy(entity, step, "_slice").orderBy("_code", *ids).rowsBetween(W.unboundedPreceding, -1)
    rows = add_slices(events).withColumns(
        {
            "_n_local": F.count("*").over(inside),
            "_a_local": F.coalesce(F.sum(money(F.col(amount))).over(inside), F.lit(0)),
        }
    )
    joined = rows.join(history, [entity, step, "_slice"], "left")
    same_step = F.col("_n_local") + F.col("_n_slices")
    same_step_amount = F.col("_a_local") + F.col("_a_slices")

    features = {
        f"{prefix}_previous_gap": F.when(F.col("_n_slices").isNull(), 0.0)
        .when(same_step > 0, 0.0)
        .otherwise(F.coalesce((F.col(step) - F.col("_prev_step")).cast("double"), F.lit(-1.0)))
    }
    for w in windows:
        count = F.coalesce(same_step + F.coalesce(f"_n_{w}", F.lit(0)), F.lit(0))
        total = F.coalesce(same_step_amount + F.coalesce(f"_a_{w}", F.lit(0)), F.lit(0))
        features[f"{prefix}_count_prev_{w}"] = count.cast("double")
        features[f"{prefix}_amount_prev_{w}"] = total.cast("double")
    return with_ratios(joined.select(*events.columns, *[c.alias(n) for n, c in features.items()]), prefix, windows)


def with_ratios(history: DataFrame, prefix: str, windows: Sequence[int]) -> DataFrame:
    """Adds the ratios of the shortest to the longest window."""
    longest = windows[-1]
    return history.withColumns(
        {
            f"{prefix}_{ratio}_ratio_1_to_{longest}": safe_divide(
                F.col(f"{prefix}_{part}_prev_1"), F.col(f"{prefix}_{part}_prev_{longest}")
            )
            for ratio, part in (("velocity", "count"), ("amount", "amount"))
        }
    )


ENTITY_ROLES = (
    ("source_account_id", "source_account"),
    ("destination_account_id", "destination_account"),
    ("source_party_id", "source_party"),
)


def transaction_history(transactions: DataFrame, *, windows: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """The trailing history of every transaction in its three entity roles (9 columns each).

    The rows flow through the three enrichments, so nothing is joined back on the transaction id.
    """
    result = transactions
    for entity, prefix in ENTITY_ROLES:
        result = add_trailing_history(result, entity, prefix, windows=windows, base=transactions)
    return result


def party_activity(
    transactions: DataFrame, parties: DataFrame, *, windows: Sequence[int] = (1, 7, 30)
) -> DataFrame:
    """Gap and recency features per party, both directions.

    Gaps between consecutive events telescope: their sum is last - first step, and same-step
    neighbours contribute 0. Per-step totals are therefore enough, no event-level window runs.
    """
    windows = checked_windows(windows)
    latest = transactions.agg(F.max("event_step")).scalar()
    longest = windows[-1]

    def direction(entity: str, name: str) -> DataFrame:
        steps = (
            transactions.where(F.col(entity).isNotNull())
            .groupBy(F.col(entity).alias("party_id"), "event_step")
            .agg(F.count("*").alias("n"), money_sum(F.col("amount")).alias("a"))
        )
        timeline = W.partitionBy("party_id").orderBy("event_step")
        steps = steps.withColumn("gap", F.col("event_step") - F.lag("event_step").over(timeline))
        steps = steps.withColumn("latest", latest)
        recent = []
        for w in windows:
            inside = F.col("event_step") >= F.col("latest") - w + 1
            recent += [
                F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"{name}_count_recent_{w}"),
                F.sum(F.when(inside, F.col("a")).otherwise(0)).cast("double").alias(f"{name}_amount_recent_{w}"),
            ]
        span = F.max("event_step") - F.min("event_step")
        return steps.groupBy("party_id").agg(
            F.min("event_step").alias(f"{name}_first"),
            F.max("event_step").alias(f"{name}_last"),
            safe_divide(span.cast("double"), (F.sum("n") - 1).cast("double")).alias(f"average_{name}_gap"),
            F.coalesce(F.max("gap"), F.lit(0)).cast("double").alias(f"max_{name}_gap"),
            *recent,
        )

    outgoing = (
        direction("source_party_id", "outgoing")
        .withColumnsRenamed({"outgoing_first": "first_activity_step", "outgoing_last": "last_activity_step"})
        .withColumns(
            {
                "activity_span_steps": F.col("last_activity_step") - F.col("first_activity_step"),
                f"outgoing_velocity_ratio_1_to_{longest}": safe_divide(
                    F.col("outgoing_count_recent_1").cast("double"),
                    F.col(f"outgoing_count_recent_{longest}").cast("double"),
                ),
            }
        )
    )
    incoming = direction("destination_party_id", "incoming").drop("incoming_first", "incoming_last")
    joined = parties.select("party_id").join(outgoing, "party_id", "left").join(incoming, "party_id", "left")
    return joined.fillna(0)


def party_activity_names(windows: Sequence[int]) -> list[str]:
    windows = checked_windows(windows)

    def recents(name: str) -> list[str]:
        return [f"{name}_{what}_recent_{w}" for w in windows for what in ("count", "amount")]

    return [
        "first_activity_step",
        "last_activity_step",
        "activity_span_steps",
        "average_outgoing_gap",
        "max_outgoing_gap",
        *recents("outgoing"),
        f"outgoing_velocity_ratio_1_to_{windows[-1]}",
        "average_incoming_gap",
        "max_incoming_gap",
        *recents("incoming"),
    ]
