"""Trailing history of arriving transactions, from keyed state instead of the stored past."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.functions.columns import MONEY
from riskloom.operators.trailing import with_ratios
from riskloom.settings import checked_windows

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_ids(ids: pd.Series) -> pd.Series:
    """Ids as numbers if all of them are numbers, else as text."""
    numbers = pd.to_numeric(ids, errors="coerce")
    return ids.astype(str) if numbers.isna().any() else numbers


def fixed_point(amount) -> Decimal:
    """The amount as ``MONEY``, rounded as a cast does; an absent one is nothing."""
    if amount is None or amount != amount:
        return Decimal(0)
    return Decimal(str(amount)).quantize(Decimal(1).scaleb(-MONEY.scale), ROUND_HALF_UP)


class StepBuckets(StatefulProcessor):
    """Per entity: count and amount of every step that the longest window still reaches, and the last step seen."""

    def __init__(self, windows: tuple[int, ...], prefix: str, step: str, amount: str, identifier: str):
        self.windows, self.prefix, self.step, self.amount, self.identifier = windows, prefix, step, amount, identifier

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getListState("steps", f"step bigint, n bigint, amount {MONEY.simpleString()}")
        self.last = handle.getValueState("last", "step bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = list(rows)
        ids = [row[self.identifier] for row in arrived]
        if not all(isinstance(i, int) for i in ids):
            ids = ordered_ids(pd.Series(ids)).tolist()
        arrived = [row for _, _, _, row in sorted((row[self.step], i, at, row) for at, (i, row) in enumerate(zip(ids, arrived)))]
        # read and written whole, in one exchange with the store each
        kept = {s: (n, a) for s, n, a in self.steps.get()}
        known = self.last.get()
        latest = None if known is None else known[0]
        order = sorted(kept)
        reach = self.windows[-1]
        names = [f"{self.prefix}_previous_gap"]
        names += [f"{self.prefix}_{part}_prev_{w}" for w in self.windows for part in ("count", "amount")]
        extended = Row(*arrived[0].__fields__, *names)
        for arrival in arrived:
            step, amount = arrival[self.step], arrival[self.amount]
            upto = bisect_right(order, step)
            earlier = order[upto - 1] if upto else None
            if latest is not None and latest <= step:
                earlier = latest
            row = [-1.0 if earlier is None else float(step - earlier)]
            for w in self.windows:
                seen = [kept[s] for s in order[bisect_left(order, step - w) : upto]]
                row += [float(sum(n for n, _ in seen)), float(sum((a for _, a in seen), Decimal(0)))]
            yield extended(*arrival, *row)
            count, total = kept.get(step, (0, Decimal(0)))
            if step not in kept:
                order.insert(bisect_left(order, step), step)
            kept[step] = (count + 1, total + fixed_point(amount))
            latest = step if latest is None else max(latest, step)
        self.steps.put([(s, *kept[s]) for s in order if s >= latest - reach])
        self.last.update((latest,))

    def close(self) -> None:
        pass


def stream_history(
    stream: DataFrame,
    entity: str,
    prefix: str,
    target: str,
    checkpoint: str,
    *,
    windows: Sequence[int] = (1, 7, 30),
    step: str = "event_step",
    amount: str = "amount",
    identifier: str = "transaction_id",
) -> DataFrame:
    """Appends every arriving transaction with the trailing history of its ``entity`` to a Parquet table (exactly once)
    and returns the table: the columns that ``add_trailing_history`` adds, without reading the past again.

    Rows of one entity that arrive together are taken in (step, id) order, so a stream in step order gives what the
    batch job gives. A row that arrives after later ones counts what came before it in arrival and is not older than
    the window; rows already written are not changed. Rows without an entity get zeros; a NULL amount counts as
    nothing. State per entity: one bucket per step that the longest window reaches back from the last, and that step.
    A restart with the same ``checkpoint`` goes on from the state. The task that holds an entity also holds the rows
    that it gets in one batch: bound them by the files of a batch.
    """
    spark = stream.sparkSession
    windows = checked_windows(windows)
    fields = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    names = [f"{prefix}_previous_gap"] + [f"{prefix}_{part}_prev_{w}" for w in windows for part in ("count", "amount")]
    added = ", ".join(f"`{n}` double" for n in names)
    keyed = stream.where(F.col(entity).isNotNull()).groupBy(entity)
    history = keyed.transformWithState(
        statefulProcessor=StepBuckets(windows, prefix, step, amount, identifier),
        outputStructType=f"{fields}, {added}",
        outputMode="append",
        timeMode="none",
    )
    blank = stream.where(F.col(entity).isNull()).withColumns({n: F.lit(0.0) for n in names})
    rows = with_ratios(history.unionByName(blank), prefix, windows)
    store = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)  # read when the query starts; the only store with map state
    try:
        query = (
            rows.writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, store)
    return spark.read.schema(rows.schema).parquet(target)
