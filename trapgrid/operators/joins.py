"""Left joins in which missing keys match each other, safe for keys that hold much of the data."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.session import checkpointed, shuffle_partitions

# What one salted part of a key may hold, as a share of a task's mean load.
_PART_OF_TASK = 0.5
# Keys that a sketch tracks for each key that can be heavy: its error is then a small part of the
# limit. The function takes a million at most.
_TRACKED_PER_KEY, _MOST_TRACKED = 16, 1_000_000


def _limit(partitions: int) -> float:
    """Share of the rows from which on a key is heavy; fewer than its inverse can be."""
    return max(_PART_OF_TASK / partitions, 2.0 * _TRACKED_PER_KEY / _MOST_TRACKED)


def _plain(value: Column, kind: T.DataType) -> Column:
    """The value with one form for equal numbers: 0.0 and -0.0 are one key, inside structs and arrays too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def _key(df: DataFrame, keys: list[str]) -> Column:
    """The keys of a row as one text, which is the same for the same keys; missing ones count."""
    columns = [_plain(F.col(f"`{k}`"), df.schema[k].dataType).alias(k) for k in keys]
    if len(columns) == 1:
        return F.coalesce(F.concat(F.lit("="), columns[0].cast("string")), F.lit(""))
    return F.to_json(F.struct(*columns))


def _salted(counted: DataFrame, count: Column, total: Column, partitions: int) -> DataFrame:
    """(_k, _salts) of the keys over the limit, each with as many salts as keep a part below it."""
    share = count / total
    heavy = counted.where((share > _limit(partitions)) & (count > 1))
    return heavy.select("_k", F.ceil(share / _limit(partitions)).cast("long").alias("_salts"))


def heavy_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_k, _salts): the keys that hold more of `rows` than a part of a task's load, and their number of salts.

    One pass over the key columns. Each task keeps a sketch of bounded size, and the sketches
    are merged in two steps, so that neither the keys nor all sketches go through one task. The
    list is kept by a checkpoint: whoever uses it sees the same keys.
    """
    partitions = shuffle_partitions(rows.sparkSession)
    most = math.ceil(1 / _limit(partitions))
    size = F.lit(min(max(_TRACKED_PER_KEY * most, 1024), _MOST_TRACKED))
    group = (F.spark_partition_id() % math.ceil(math.sqrt(partitions))).alias("_g")
    parts = rows.select(group, _key(rows, keys).alias("_k")).groupBy("_g").agg(
        F.call_function("approx_top_k_accumulate", F.col("_k"), size).alias("_s"), F.count("*").alias("_n")
    )
    # Grouped by a constant, so that no rows give no group instead of an empty sketch.
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(
        F.call_function("approx_top_k_combine", F.col("_s"), size).alias("_s"), F.sum("_n").alias("_n")
    )
    top = F.call_function("approx_top_k_estimate", F.col("_s"), F.lit(most))
    listed = whole.select(F.explode(top).alias("_top"), "_n").select(F.col("_top.item").alias("_k"), F.col("_top.count").alias("_c"), "_n")
    return checkpointed(_salted(listed, F.col("_c"), F.col("_n"), partitions))


def heavy_of_counts(counted: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The same list from a table with the exact number of rows of each key."""
    total = counted.agg(F.sum(count)).scalar()
    named = counted.withColumn("_k", _key(counted, keys))
    return checkpointed(_salted(named, F.col(count), total, shuffle_partitions(counted.sparkSession)))


def _row_salt(columns: list[str], salts: Column) -> Column:
    # Stays the same when a task is run again; splits even rows that are exact copies.
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in columns]), salts)


def _match(on: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in on])


def _dealt(rows: DataFrame, on: list[str], heavy: DataFrame, name: str, salt_by: list[str] | None) -> DataFrame:
    """`rows` with the column `name`: by `salt_by` one salt of a heavy key, or without it a row for each; 0 for other keys."""
    # The list has fewer keys than the inverse of the limit.
    marked = rows.withColumn("_k", _key(rows, on)).join(F.broadcast(heavy), "_k", "left").drop("_k")
    zero = F.lit(0).cast("long")
    if salt_by is not None:
        salt = F.when(F.col("_salts").isNotNull(), _row_salt(salt_by, F.col("_salts"))).otherwise(zero)
    else:
        salt = F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(zero, F.col("_salts") - 1)).otherwise(F.array(zero)))
    return marked.withColumn(name, salt)


def left_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    right_unique: bool = False,
    heavy: DataFrame | None = None,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Left equi-join on equally named columns; missing equals missing; keys come from `left`.

    Rows of a key that is heavy on one side are salted there and repeated per salt on the
    other, so that no task gets them all. A key has salts by its share of the rows, and all
    keys together fewer than four for each shuffle partition. `right_unique` says that `right` has one row per
    key, which saves looking for heavy keys in it. `heavy` gives the heavy keys of `left`, as from
    heavy_of_counts, where the caller has counted them already. `salt_by` names
    columns of `left` that differ between rows of a key, so that the others need not be read
    for the salt. The lists of heavy keys are made when this is called.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"rename or drop before the join: {sorted(clash)}")
    for c in on:
        # Equal values of different types need not have equal texts.
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"{c} is {left.schema[c].dataType} on the left and {right.schema[c].dataType} on the right")
    # Both sides are dealt by one list, made once: a row is salted here if and only if it is repeated there.
    heavy_left = heavy_keys(left, on) if heavy is None else heavy
    a = _dealt(left, on, heavy_left, "_a", salt_by or left.columns).drop("_salts")
    b = _dealt(right, on, heavy_left, "_a", None).drop("_salts")

    salted = ["_a"]
    if not right_unique:
        # The keys themselves, not hashes: such a key is known to exist in `right`.
        heavy_right = heavy_keys(right, on)
        a = _dealt(a, on, heavy_right, "_b", None).withColumnRenamed("_salts", "_r")
        b = _dealt(b, on, heavy_right, "_b", right.columns).drop("_salts").withColumn("_hit", F.lit(True))
        salted.append("_b")

    b = b.withColumnsRenamed({c: f"_right_{c}" for c in [*on, *salted]})
    same_salt = [F.col(c) == F.col(f"_right_{c}") for c in salted]
    joined = a.join(b, reduce(and_, same_salt, _match(on, "_right_")), "left")
    if not right_unique:
        # Repeats of a row whose salt held no partner; another repeat of it has one.
        joined = joined.where(F.col("_r").isNull() | F.col("_hit"))
    return joined.select(*left.columns, *[c for c in right.columns if c not in on])


def natural_left_join(left: DataFrame, right: DataFrame, right_unique: bool = False) -> DataFrame:
    """Left join on all shared columns."""
    return left_join(left, right, [c for c in left.columns if c in right.columns], right_unique)


def without_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `left` whose key is not in `right`; missing equals missing."""
    keys = right.select(*on).distinct().withColumn("_known", F.lit(True))
    return left_join(left, keys, on, right_unique=True).where(F.col("_known").isNull()).drop("_known")


def override(df: DataFrame, key: str, column: str, values: dict[str, object]) -> DataFrame:
    """`column` replaced for the keys in `values` (a dict the caller wrote, so it is small)."""
    out = None
    for name, value in values.items():
        hit, new = F.col(key) == name, F.lit(value).cast(df.schema[column].dataType)
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return df if out is None else df.withColumn(column, out.otherwise(F.col(column)))


def first_match(wanted: DataFrame, listing: DataFrame, name: str, order: str) -> DataFrame:
    """Each wanted name with the first listed row of that name, or missing."""
    return left_join(wanted, first_per_key(listing, [name], [order]), [name], right_unique=True)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, ties broken by the other columns.

    An aggregate, not a window: each task keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min(rank).alias("_first"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
