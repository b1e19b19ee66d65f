"""Global order without one task holding it: range partitions, a window inside each, offsets between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.session import materialise


def range_sorted(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Stored rows with ``_part``, ascending with the order; equal order values share a part."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # stored, because partition ids must not be drawn again with other range bounds
    return materialise(ranged.withColumn("_part", F.spark_partition_id()), name)


def part_offsets(stored: DataFrame, sizes: Sequence[str]) -> DataFrame:
    """One row per part: the sums of ``sizes`` over all earlier parts. At most as many rows as partitions."""
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = stored.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sizes])
    return parts.select("_part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sizes])


def prefix_sums(df: DataFrame, order: Sequence[Column], sizes: Sequence[str], name: str) -> DataFrame:
    """Adds ``<size>_before``: the sum of the sizes of all rows earlier in the order."""
    stored = range_sorted(df, order, name)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = stored.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_l_{s}") for s in sizes])
    # one row per partition: small by construction
    joined = sums.join(F.broadcast(part_offsets(stored, sizes)), "_part")
    return joined.select(*df.columns, *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"{s}_before") for s in sizes])
