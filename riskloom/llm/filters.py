"""A bit set of hashes, tested while texts are scanned, so that only rows with a chance to join are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Marks the upper ``bits`` bits of the column ``hash``. The size is fixed: at most 2**(bits - 6) numbers reach
    the driver, whatever the input; more hashes only let more rows pass, never fewer."""
    inside = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
    marked = hashes.select(F.shiftrightunsigned("hash", 64 - bits + 6).alias("at"), inside.alias("bit"))
    rows = marked.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(table).bit_length() - 1) - 6)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
