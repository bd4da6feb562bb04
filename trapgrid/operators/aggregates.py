"""Counts, profiles and frequency tables. Every group is pre-aggregated before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, value: str) -> DataFrame:
    """(value, n) for each value that is not missing."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row × column with zero cells; `values` are the columns to make."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.na.fill(0, [str(v) for v in values])


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, n_missing) of every column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns])
    return counted.select(F.inline(pairs))


def distinct_count(value: str) -> Column:
    """Number of values, missing counted as one."""
    return F.count_distinct(F.col(value)) + F.coalesce(F.max(F.col(value).isNull().cast("int")), F.lit(0))


def duplicate_count(value: str) -> Column:
    """Number of rows whose value was there before."""
    return F.count("*") - distinct_count(value)


def histogram(df: DataFrame, value: str, low: float, width: float, n: int) -> DataFrame:
    """(bin, n) of `n` equal-width bins from `low`, empty ones too. Bins are closed on the right, and bin 1
    also holds `low`. The row without a bin counts the values outside all bins; missing values are left out."""
    number = F.greatest(F.ceil((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(1))
    inside = (F.col(value) >= F.lit(low)) & (number <= n) & ~F.isnan(value)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.when(inside, number).cast("int").alias("_bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(i,) for i in [None, *range(1, n + 1)]], "bin int")
    joined = bins.join(counts, F.col("bin").eqNullSafe(F.col("_bin")), "left")
    return joined.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unreadable(text: Column, value: Column) -> Column:
    """How many texts there are without the value they were to be read as; for `agg`, or for `observe` in the pass that uses the value."""
    return F.count_if(text.isNotNull() & value.isNull())
