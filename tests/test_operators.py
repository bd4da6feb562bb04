"""Joins, ranks and statistics against brute force in plain Python, with hot and missing keys."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trapgrid.operators import aggregates, joins, ranking


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def left_join_by_hand(left, right):
    out = []
    for a in left:
        hits = [b for b in right if a[0] == b[0]]
        out += [(*a, b[1]) for b in hits] or [(*a, None)]
    return sorted(out, key=repr)


def sample(seed, n, hot):
    """n rows, a third of them with the key `hot` and a third without a key."""
    rng = random.Random(seed)
    return [(rng.choice([hot, None, f"k{rng.randrange(20)}"]), i) for i in range(n)]


@pytest.mark.parametrize("right_n", [0, 40])
@pytest.mark.parametrize("hot_left, hot_right", [("h", "h"), ("h", "k3"), ("only-left", "only-right")])
def test_left_join_with_hot_and_missing_keys(spark, hot_left, hot_right, right_n):
    left, right = sample(1, 120, hot_left), sample(2, right_n, hot_right)
    a = spark.createDataFrame(left, "key string, a int").repartition(5)
    b = spark.createDataFrame(right, "key string, b int")
    assert rows(joins.left_join(a, b, ["key"])) == left_join_by_hand(left, right)


def test_left_join_unique_right_and_exact_copies(spark):
    left = [("h", 1)] * 300 + [("x", 1), (None, 2), ("y", 3)]
    right = [("h", 10), (None, 20), ("x", 30)]
    a = spark.createDataFrame(left, "key string, a int")
    b = spark.createDataFrame(right, "key string, b int")
    assert rows(joins.left_join(a, b, ["key"], right_unique=True)) == left_join_by_hand(left, right)
    assert rows(joins.without_match(a, b, ["key"])) == [("y", 3)]


def test_left_join_on_two_keys_and_name_clash(spark):
    a = spark.createDataFrame([(1, None, "p"), (1, "u", "q")], "k int, j string, a string")
    b = spark.createDataFrame([(1, None, "r")], "k int, j string, b string")
    assert rows(joins.natural_left_join(a, b)) == [(1, "u", "q", None), (1, None, "p", "r")]
    with pytest.raises(ValueError):
        joins.left_join(a, b.withColumnRenamed("b", "a"), ["k", "j"])


def test_heavy_keys_are_the_frequent_ones(spark):
    df = spark.createDataFrame([("h",)] * 30_000 + [(str(i),) for i in range(40_000)], "key string")
    listed = joins.heavy_keys(df, ["key"]).collect()
    assert [r._k for r in listed] == ["=h"]
    # A third of the rows and more, in parts of half a task's load each.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert listed[0]._salts == pytest.approx(3 / 7 * 2 * partitions, abs=1.5)


def test_salts_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame([("h",)] * 900 + [("k",)] * 90 + [(str(i),) for i in range(10)], "key string")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        salts = {r._k: r._salts for r in joins.heavy_keys(df, ["key"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1750 <= salts["=h"] <= 1850 and 170 <= salts["=k"] <= 190


def test_left_join_beyond_the_sketch_without_shared_exchanges(spark):
    """More keys than a sketch tracks, hot and missing keys on both sides, each exchange run on its own."""
    left = [(f"k{i}", i) for i in range(6000)] + [("h", i) for i in range(2000)] + [(None, 1)] * 30 + [("r", 5)] * 3
    right = [(f"k{i * 2}", i) for i in range(6000)] + [("r", i) for i in range(1500)] + [("h", 1), ("h", 2), (None, 7)]
    a, b = spark.createDataFrame(left, "key string, a int").repartition(7), spark.createDataFrame(right, "key string, b int").repartition(5)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = joins.left_join(a, b, ["key"]).groupBy("key").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        named = b.withColumnRenamed("key", "other")
        plain = a.join(named, F.col("key").eqNullSafe(F.col("other")), "left").groupBy("key").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        assert rows(got) == rows(plain)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_positions_need_one_shuffle(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("v"))
    plan = ranking.with_row_number(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    # After the range shuffle, which the checkpoint holds, only the totals of the partitions are exchanged.
    assert plan.count("hashpartitioning") <= 1 and "rangepartitioning" not in plan


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, "n")], "f string, o int, v string")
    assert rows(joins.first_per_key(df, ["f"], ["o"])) == [("a", 1, "y"), (None, 5, "n")]


def test_first_match_is_missing_without_a_file(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "name string")
    listing = spark.createDataFrame([("z/a", "a"), ("y/a", "a")], "path string, name string")
    assert rows(joins.first_match(wanted, listing, "name", "path")) == [("a", "y/a"), ("b", None)]


def test_override(spark):
    df = spark.createDataFrame([("a", None), ("b", "2015-01-01")], "k string, d string").withColumn("d", F.col("d").cast("date"))
    out = joins.override(df, "k", "d", {"a": "2015-08-18"})
    assert [str(r.d) for r in out.orderBy("k").collect()] == ["2015-08-18", "2015-01-01"]


def test_row_numbers_and_slices(spark):
    values = random.Random(3).sample(range(1000), 200)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = [tuple(r) for r in ranking.with_row_number(df, ["v"]).orderBy("v").collect()]
    assert got == [(v, i + 1) for i, v in enumerate(sorted(values))]
    assert rows(ranking.row_slice(df, ["v"], 30, 43)) == sorted([(v,) for v in sorted(values)[29:43]], key=repr)


def test_dense_codes_restart_per_group(spark):
    df = spark.createDataFrame(
        [("f1", "b"), ("f1", "a"), ("f1", "b"), ("f2", "b"), ("f2", None), ("f2", "c")], "f string, d string"
    )
    assert rows(ranking.add_dense_code(df, ["f"], "d", "code")) == sorted(
        [("f1", "b", 2), ("f1", "a", 1), ("f1", "b", 2), ("f2", "b", 1), ("f2", None, None), ("f2", "c", 2)], key=repr
    )


def test_row_numbers_of_copies_and_of_nothing(spark):
    copies = spark.createDataFrame([("a",)] * 50, "v string").repartition(4)
    assert sorted(r.row_number for r in ranking.with_row_number(copies, ["v"]).collect()) == list(range(1, 51))
    nothing = spark.createDataFrame([], "v double")
    assert ranking.with_row_number(nothing, ["v"]).count() == 0
    assert tuple(ranking.six_numbers(nothing, "v").first()) == (None,) * 6 + (0,)


def test_sort_spread(spark):
    df = spark.createDataFrame([(2, "b"), (None, "c"), (1, "z"), (2, "a")], "k int, v string").repartition(3)
    got = [tuple(r) for r in ranking.sort_spread(df, F.asc_nulls_last("k")).collect()]
    assert got == [(1, "z"), (2, "a"), (2, "b"), (None, "c")]


@pytest.mark.parametrize("values", [[1, 2, 4, 8], [5], [1, 1, 1, 9], list(range(101))])
def test_six_numbers(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = ranking.six_numbers(df, "x").first()
    if len(values) > 1:
        quartiles = statistics.quantiles(values, n=4, method="inclusive")
        assert [got.q1, got.median, got.q3] == pytest.approx(quartiles)
    assert (got.min, got.max, got.n) == (min(values), max(values), len(values))
    assert got["mean"] == pytest.approx(sum(values) / len(values))


def test_missing_counts_as_a_value(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("a",), ("b",)], "x string")
    got = df.agg(aggregates.distinct_count("x"), aggregates.duplicate_count("x")).first()
    assert tuple(got) == (3, 2)
    assert rows(aggregates.missing_counts(df)) == [("x", 2)]
    assert rows(aggregates.frequency(df, "x")) == [("a", 2), ("b", 1)]


def test_histogram_is_closed_on_the_right_and_complete(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (0.5,), (None,), (-5.0,), (float("nan"),), (1.01,)], "x double")
    assert rows(aggregates.histogram(df, "x", 0.0, 0.25, 4)) == sorted([(1, 2), (2, 2), (3, 0), (4, 0), (None, 3)], key=repr)


def test_crosstab(spark):
    df = spark.createDataFrame([("a", 2015), ("a", 2015), ("b", 2016)], "c string, y int")
    assert rows(aggregates.crosstab(df, "c", "y", [2015, 2016])) == [("a", 2, 0), ("b", 0, 1)]


@pytest.mark.parametrize("kind", ["double", "float", "struct<a:double>", "array<double>", "date", "decimal(9,2)", "binary", "boolean"])
def test_heavy_keys_of_any_type_match_by_value(spark, kind):
    """A key of most rows, 0.0 on the one side and -0.0 on the other, joins as in a plain join."""
    zero, other = {
        "double": ("0.0D", "1.5D"), "float": ("float(0)", "float(2)"), "struct<a:double>": ("named_struct('a', 0.0D)", "named_struct('a', 1D)"),
        "array<double>": ("array(0.0D)", "array(1D)"), "date": ("date'2015-01-01'", "date'2016-01-01'"), "decimal(9,2)": ("0.50", "1.00"),
        "binary": ("X'00FF'", "X'01'"), "boolean": ("true", "false"),
    }[kind]
    minus = zero.replace("0.0D", "-0.0D").replace("float(0)", "float(-0.0D)")
    left = spark.range(4000).selectExpr("id", f"cast(case when id % 80 < 78 then {zero} when id % 80 = 78 then {other} end as {kind}) as k")
    right = spark.range(3).selectExpr(f"cast(case id when 0 then {minus} when 1 then {other} end as {kind}) as k", "id as r")
    got = {r.id: r.r for r in joins.left_join(left, right, ["k"]).collect()}
    assert got == {i: 0 if i % 80 < 78 else 1 if i % 80 == 78 else 2 for i in range(4000)}
