"""Ordered computations that do not need one group's rows in one task.

* ``running_totals``: prefix sums over a value ordering. Each group is cut into equi-depth slices,
  a window runs inside a slice, and the slice totals (few per group) supply the offsets.
* ``bracketed_quantiles``: linear-interpolated quantiles; only values near them are shuffled.
* ``keep_first``: deterministic keyed dedupe.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.session import materialise

FANOUT = 16


def with_slice(df: DataFrame, value: Column, bounds: str, levels: int, name: str = "_slice") -> DataFrame:
    """Adds the number of slice boundaries at or below ``value``.

    ``bounds`` names an ascending array of FANOUT**levels - 1 boundaries. Each level is a 16-way tree of
    ``when`` expressions, four comparisons per row in generated code; a level's result is a column of
    its own, so the next level does not repeat its expression.
    """

    def descend(base: Column, step: int, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low * step)
        middle = (low + high + 1) // 2
        boundary = F.get(F.col(bounds), base + F.lit(middle * step - 1))
        return F.when(value >= boundary, descend(base, step, middle, high)).otherwise(
            descend(base, step, low, middle - 1)
        )

    result = df.withColumn(name, descend(F.lit(0), FANOUT ** (levels - 1), 0, FANOUT - 1))
    for level in range(levels - 2, -1, -1):
        base = F.col(name)
        result = result.withColumn(name, base + descend(base, FANOUT**level, 0, FANOUT - 1))
    return result


def slice_percentages(levels: int) -> list[float]:
    slices = FANOUT**levels
    return [i / slices for i in range(1, slices)]


def running_totals(
    rows: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    levels: int = 2,
    stored: bool = False,
) -> DataFrame:
    """Adds ``<value>_upto`` (inclusive prefix sum in ascending ``order``) to every row.

    ``rows`` must hold one row per (groups, order), with a numeric order column: pre-aggregate first,
    which also removes the skew of frequent values. One group is spread over 16**levels tasks. A NULL is a
    group like any other; a NULL order value has no place and raises. Unless they are ``stored`` already, the pre-aggregated rows are written once: they are read for the
    boundaries and again for the sums, and their source should not be scanned for each.
    """
    if not stored:
        rows = materialise(rows, "ordered")
    columns = rows.columns
    # a struct is never NULL, so that NULL groups meet in joins as they do in aggregates
    rows = rows.withColumn("_group", F.struct(*groups)) if groups else rows
    groups = ["_group"] if groups else []
    missing = F.raise_error(F.lit(f"running_totals: {order} is NULL")).cast(rows.schema[order].dataType)
    rows = rows.withColumn(order, F.coalesce(F.col(order), missing))
    order_number = F.col(order).cast("double")
    accuracy = 20 * FANOUT**levels
    bounds = rows.groupBy(*groups).agg(
        F.percentile_approx(order_number, slice_percentages(levels), accuracy).alias("_bounds")
    )
    bounded = rows.join(bounds, groups) if groups else rows.withColumn("_bounds", bounds.scalar())
    keys = [*groups, "_slice"]
    # one exchange feeds both the slice totals and the window inside a slice
    sliced = with_slice(bounded, order_number, "_bounds", levels).drop("_bounds").repartition(*keys)
    # at most 16**levels rows per group from here on
    # (the unused minimum keeps the columns of both reads of the exchange equal, so it is shared)
    totals = sliced.groupBy(*keys).agg(F.min(order).alias("_low"), *[F.sum(v).alias(f"_t_{v}") for v in values])
    before = W.partitionBy(*(groups or [F.lit(1)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_low", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(inside).alias(f"_l_{v}") for v in values])
    return local.join(offsets, keys).where(F.col(order) >= F.col("_low")).select(
        *columns, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"{v}_upto") for v in values]
    )


# accuracy of the bounds between which exact ranks are counted: about 4 rows in so many are looked at again
BRACKET = 10_000
# distinct values of a bracket that one task may order
NARROW = 1_000_000


def bracketed_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, exact; NULL and NaN are skipped, None where nothing is left.

    A first pass counts and finds approximate bounds around every quantile, for all columns at once. A second one
    counts what lies below each bracket and the values inside it: 4 in BRACKET of the rows, grouped before they are
    shuffled. A bracket that turns out not to hold its ranks is replaced by all values of its column.
    """
    columns = list(wanted)
    if not columns:
        return {}
    typed = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    slots = [(i, p) for i, c in enumerate(columns) for p in wanted[c]]
    reach = 2.0 / BRACKET
    bounds = []
    for i, p in slots:
        around = [max(0.0, p - reach), min(1.0, p + reach)]
        bounds.append(F.percentile_approx(f"c{i}", around, BRACKET).alias(f"b{len(bounds)}"))
    first = typed.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))], *bounds).first()
    brackets, ranks = [], []
    for k, (i, p) in enumerate(slots):
        n, low_high = first[f"n{i}"], first[f"b{k}"]
        position = (n - 1) * p
        ranks.append((math.floor(position), math.ceil(position), position - math.floor(position)))
        low, high = low_high or (None, None)
        brackets.append((low if p > reach else float("-inf"), high if p < 1 - reach else float("inf")) if n else None)

    def counted(brackets: list) -> tuple[list[int], DataFrame]:
        """(rows below each bracket, stored (slot, value, n) inside)."""
        used = [(k, slots[k][0], *b) for k, b in enumerate(brackets) if b]
        below = typed.agg(*[F.count_if(F.col(f"c{i}") < F.lit(low)).alias(f"k{k}") for k, i, low, _ in used]).first().asDict()
        inside = [F.when(F.col(f"c{i}").between(F.lit(low), F.lit(high)), F.struct(F.lit(k).alias("slot"), F.col(f"c{i}").alias("value"))) for k, i, low, high in used]
        near = typed.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("s")).select("s.slot", "s.value")
        return below, materialise(near.groupBy("slot", "value").agg(F.count("*").alias("n")), "brackets")

    found: dict[int, tuple[float, float]] = {}
    open_ = [b is not None for b in brackets]
    while any(open_):
        below, rows = counted([b if o else None for b, o in zip(brackets, open_)])
        if rows.count() > NARROW:
            placed = running_totals(rows, ["slot"], "value", ["n"], stored=True)
        else:
            upto = W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
            placed = rows.withColumn("n_upto", F.sum("n").over(upto))
        start = F.create_map(*[F.lit(x) for k in range(len(slots)) if open_[k] for x in (k, below[f"k{k}"])])
        lower, upper = (F.create_map(*[F.lit(x) for k in range(len(slots)) if open_[k] for x in (k, ranks[k][end])]) for end in (0, 1))
        upto = F.col("n_upto") + start[F.col("slot")]
        at = [F.max(F.when((upto - F.col("n") <= m[F.col("slot")]) & (m[F.col("slot")] < upto), F.col("value"))) for m in (lower, upper)]
        got = {r[0]: (r[1], r[2]) for r in placed.groupBy("slot").agg(*at).collect()}
        for k, o in enumerate(open_):
            if o and None not in got.get(k, (None, None)):
                found[k], open_[k] = got[k], False
            elif o:
                brackets[k] = (float("-inf"), float("inf"))
    result: dict[str, list[float | None]] = {c: [] for c in columns}
    for k, (i, _) in enumerate(slots):
        low, high = found.get(k, (None, None))
        result[columns[i]].append(None if low is None else low + (high - low) * ranks[k][2])
    return result


def exact_quantiles(df: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    """One row with the linear-interpolated quantiles (named by the dict keys); NULLs are skipped."""
    values = bracketed_quantiles(df.select(F.col(column).alias("x")), {"x": list(probabilities.values())})["x"]
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(probabilities, values)])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in ``order``. The rank filter is pushed below the shuffle (window group
    limit), so a key repeated in a third of all rows sends one row per task."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= k)
