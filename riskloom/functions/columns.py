"""Column expressions: tolerant coercions, stable hashing, safe arithmetic.

Everything is a built-in expression, so it stays inside whole-stage codegen. Spark 4 runs in ANSI
mode, hence ``try_*`` wherever input text or a divisor is not under our control.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Amounts are summed in this type: 30 digits before the point, 8 behind it. Amounts that need more of either
# side want another type here.
MONEY = T.DecimalType(38, 8)
HASH_HEX_DIGITS = 12
HASH_SPACE = 16**HASH_HEX_DIGITS
TRUE_WORDS = ("1", "true", "yes", "y")


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """First candidate present in the frame, ignoring case. Looks at the schema only."""
    present = {name.lower(): name for name in df.columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"{what}: missing required columns {', '.join(missing)}")


def null_if_blank(column: Column) -> Column:
    """Absent keys are NULL everywhere in this library; blanks would join and group."""
    return F.nullif(column, F.lit(""))


def text_column(df: DataFrame, *candidates: str, default: str = "") -> Column:
    name = find_column(df, *candidates)
    if name is None:
        return F.lit(default)
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(default)))


def number_column(df: DataFrame, *candidates: str, default: float = 0.0) -> Column:
    name = find_column(df, *candidates)
    if name is None:
        return F.lit(float(default))
    return number(F.col(name), default)


def number(column: Column, default: float = 0.0) -> Column:
    value = column.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(default)))


def whole(column: Column, default: int = 0) -> Column:
    """Truncating integer coercion of a numeric expression."""
    return F.coalesce(column.try_cast("bigint"), F.lit(default).cast("bigint"))


def whole_column(df: DataFrame, *candidates: str, default: int = 0) -> Column:
    return whole(number_column(df, *candidates, default=default), default)


def flag_column(df: DataFrame, *candidates: str, default: bool = False) -> Column:
    name = find_column(df, *candidates)
    if name is None:
        return F.lit(default)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(default))
    word = F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(str(default)))))
    return word.isin(*TRUE_WORDS)


def coerced_cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column, how many non-blank cells the numeric coercion replaces by its default."""
    bad = [
        F.count_if(
            null_if_blank(F.trim(F.col(n).cast("string"))).isNotNull() & F.col(n).try_cast("double").isNull()
        ).alias(n)
        for n in names
    ]
    return df.agg(*bad).unpivot([], list(names), "column_name", "coerced_cells")


def with_prefix(df: DataFrame, prefix: str, names: Iterable[str] | None = None) -> DataFrame:
    return df.select([F.col(n).alias(prefix + n) for n in (names or df.columns)])


# pieces that rows without a key are dealt to in a join
KEYLESS_PIECES = 4096


def left_lookup(rows: DataFrame, attributes: DataFrame, key: str, by: Iterable[str]) -> DataFrame:
    """``rows.join(attributes, key, "left")`` in which rows whose key is NULL, which find nothing, are dealt to the
    tasks by a hash of the columns ``by``: a plain join sends all of them to one task."""
    dealt = F.pmod(F.xxhash64(*by), F.lit(KEYLESS_PIECES)) + 1
    # always 0 on the other side, in a form that is not folded away: a constant would be no join key
    return (
        rows.withColumn("_piece", F.when(F.col(key).isNull(), dealt).otherwise(0))
        .join(attributes.withColumn("_piece", F.pmod(F.xxhash64(key), F.lit(1))), [key, "_piece"], "left")
        .drop("_piece")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def fill_numbers(df: DataFrame) -> DataFrame:
    """0 / false for missing numeric and boolean cells; text stays NULL."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    filled = df.fillna(0, subset=numbers) if numbers else df
    return filled.fillna(False, subset=flags) if flags else filled


def money(column: Column) -> Column:
    return column.cast(MONEY)


def money_sum(column: Column) -> Column:
    """Sum in fixed point, so the total does not depend on how rows are partitioned."""
    return F.sum(money(column))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def relative_change(baseline: Column, recent: Column) -> Column:
    return safe_divide(recent - baseline, F.abs(baseline))


def at_least_zero(column: Column) -> Column:
    return F.greatest(column, F.lit(0).cast("bigint"))


def trailing_digits(column: Column) -> Column:
    return F.coalesce(null_if_blank(F.regexp_extract(column, r"(\d+)$", 1)), F.lit("0"))


def _digest_number(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def hash_bucket(value: Column, seed: Column | int, pool_size: Column | int, prefix: str) -> Column:
    """``prefix_NNN`` from a seeded sha256 of the value; equal input always gives the same bucket."""
    if isinstance(pool_size, int):
        if pool_size <= 0:
            raise ValueError("a pool needs at least one bucket")
        pool_size = F.lit(pool_size)
    if isinstance(seed, int):
        seed = F.lit(seed)
    bucket = _digest_number(F.concat_ws(":", seed.cast("string"), F.lit(prefix), value.cast("string"))) % pool_size
    # three digits at least: lpad alone would cut longer numbers
    digits = F.greatest(F.lit(3), F.length(bucket.cast("string")))
    return F.concat(F.lit(prefix + "_"), F.lpad(bucket.cast("string"), digits, F.lit("0")))


def hash_fraction(value: Column, seed: int, salt: str = "fraction") -> Column:
    """Deterministic uniform number in [0, 1) derived from the value."""
    return _digest_number(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), value.cast("string"))) / F.lit(float(HASH_SPACE))


def segment_code(bucket_id: Column, pool_size: int) -> Column:
    """1 + segment / (pool - 1): the numeric edge code of a merchant link."""
    return F.lit(1.0) + trailing_digits(bucket_id).cast("double") / F.lit(float(max(pool_size - 1, 1)))


def all_true(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
