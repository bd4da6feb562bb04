"""Row positions, dense codes and order statistics without a one-task sort."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapgrid.operators.joins import left_join
from trapgrid.session import checkpointed, shuffle_partitions


def _ranged(df: DataFrame, order: list[str], weight: Column | None) -> tuple[DataFrame, DataFrame]:
    """(rows, starts): `df` in the global order with `_part`, `_place` (in the partition, from 0) and `_w`,
    and for each partition what comes before it (`_start`) and its `_total`.

    Rows are range-partitioned, sorted there and kept that way by a checkpoint, so that the row
    ids, which count up in each partition, give the places without another shuffle.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    columns = [F.col(c) for c in order]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *columns).sortWithinPartitions(*columns)
    ranged = checkpointed(ranged.withColumn("_w", weight)).withColumn("_id", F.monotonically_increasing_id())
    placed = ranged.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    # One row per partition, so this window is as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum("_w").alias("_total"))
    return placed, totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"), "_total")


def with_positions(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "pos") -> DataFrame:
    """Adds the running total of `weight` (default 1, a row number) over the global order.

    `order` must be unique per row. Only weights other than 1 need a window in each partition.
    """
    placed, starts = _ranged(df, order, weight)
    out = placed.join(F.broadcast(starts.drop("_total")), "_part")
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_place") + 1 if weight is None else F.sum("_w").over(inside)
    return out.withColumn(name, F.col("_start") + upto).select(*df.columns, name)


def _with_ties(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    # The source partition as last key lets exact copies lie in several ranges.
    rest = [c for c in df.columns if c not in order]
    return df.withColumn("_tie", F.spark_partition_id()), [*order, *rest, "_tie"]


def with_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Row number over the whole table; columns outside `order` break ties."""
    tied, keys = _with_ties(df, order)
    return with_positions(tied, keys, name=name).drop("_tie")


def row_slice(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows number `first` to `last` (from 1, inclusive) of the ordered table.

    Rows of the other ranges are dropped by the partition totals, before anything is numbered.
    """
    placed, starts = _ranged(*_with_ties(df, order), None)
    wanted = starts.where((F.col("_start") < last) & (F.col("_start") + F.col("_total") >= first)).drop("_total")
    number = F.col("_start") + F.col("_place") + 1
    return placed.join(F.broadcast(wanted), "_part").where(number.between(first, last)).select(*df.columns)


def dense_codes(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Distinct (group, value) pairs with the value's rank among its group's values, from 1."""
    placed = with_positions(df.select(*group, value).where(F.col(value).isNotNull()).distinct(), [*group, value])
    lowest = placed.groupBy(*group).agg(F.min("pos").alias("_lowest")).withColumnsRenamed({c: f"_of_{c}" for c in group})
    # One row per group on the right, so that adaptive execution can split a large group on the left.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    joined = placed.join(lowest, same)
    return joined.select(*group, value, (F.col("pos") - F.col("_lowest") + 1).cast("int").alias(name))


def add_dense_code(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Each row with the code of its value inside its group; a missing value has none."""
    return left_join(df, dense_codes(df, group, value, name), [*group, value], right_unique=True)


def six_numbers(df: DataFrame, value: str) -> DataFrame:
    """min, q1, median, mean, q3, max and n of a numeric column, missing values left out.

    Quartiles interpolate linearly between the neighbouring order statistics. Values are
    counted first, then placed by running counts, so that no task sees them all.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    placed = with_positions(counts, ["v"], weight=F.col("n"), name="upto")
    total = placed.agg(F.sum("n")).scalar()
    shares = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    spots = placed.withColumn("_n", total)
    # 0-based ranks after - n .. after - 1 belong to a value
    picks = []
    for label, share in shares.items():
        exact = (F.col("_n") - 1) * share
        for side, rank in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            inside = (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
            picks.append(F.max(F.when(inside, F.col("v"))).alias(f"{label}_{side}"))
    stats = spots.agg(*picks, F.max("_n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))

    def between(label: str) -> Column:
        exact = (F.col("n") - 1) * shares[label]
        low, high = F.col(f"{label}_lo"), F.col(f"{label}_hi")
        return (low + (high - low) * (exact - F.floor(exact))).alias(label)

    return stats.select(
        F.col("min_lo").alias("min"),
        between("q1"),
        between("median"),
        "mean",
        between("q3"),
        F.col("max_lo").alias("max"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def sort_spread(df: DataFrame, *order: Column) -> DataFrame:
    """Global sort; the remaining columns and then the source partition break ties, so that
    equal keys and even exact copies can lie in several partitions."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns]
    return df.withColumn("_tie", F.spark_partition_id()).orderBy(*order, *rest, "_tie").drop("_tie")


def with_line_number(df: DataFrame, position: str, name: str = "line_number") -> DataFrame:
    """Adds the number, from 1, of each scanned row by its `position` (readers.line_position), file after file.

    Rows are numbered inside their blocks, which a scan bounds, and blocks by what the blocks before them hold; the table is not sorted.
    """
    # Line ids hold for one scan only, so that scan is kept.
    kept = checkpointed(df.withColumns({"_file": F.col(f"{position}.file"), "_block": F.col(f"{position}.block")}))
    inside = kept.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_block").orderBy(f"{position}.line")))
    # One row per block.
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_file", "_block").count().select("_file", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return inside.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_place")).select(*df.columns, name)


def bind_by_line(left: DataFrame, right: DataFrame, left_position: str, right_position: str) -> DataFrame:
    """The columns of both tables side by side, line by line; different numbers of lines are an error."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"rename or drop before the binding: {sorted(clash)}")
    a, b = with_line_number(left, left_position, "_line"), with_line_number(right, right_position, "_line")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} lines cannot be bound with {m}")
    return a.join(b, "_line").select(*left.columns, *right.columns)
