"""Occupancy rules on small hand-made tables, and sweeps against a loop over thresholds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trapgrid.operators import reshape
from trapgrid.plans import cellstore
from trapgrid.plans import occupancy as occ
from trapgrid.plans import sweeps
from trapgrid.sources import readers, writers

PIG = 22


def photos(spark, rows):
    data = [(cam, guess, conf, dt.datetime.fromisoformat(t)) for cam, guess, conf, t in rows]
    return spark.createDataFrame(data, "camID string, GUESS1 int, CONFIDENCE1 double, DateTimeOriginal timestamp_ntz")


def sites(spark, rows):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d)) for c, d in rows], "camID string, SetDate date")


def table(df):
    return {(r.camID, r.year, r.interval): r.occ for r in df.collect()}


def test_detection_grid(spark):
    images = photos(
        spark,
        [
            ("A", PIG, 0.9, "2015-01-01T10:00"),
            ("A", PIG, 0.5, "2015-01-20T10:00"),
            ("B", 1, 0.9, "2015-01-09T10:00"),
            ("B", PIG, 0.6, "2016-02-01T10:00"),
            ("C", 1, None, "2016-02-01T10:00"),
        ],
    )
    got = table(occ.detection_grid(images, PIG, 0.5, "week"))
    assert got == {
        ("A", 2015, 1): 1, ("B", 2015, 1): 0, ("C", 2015, 1): 0,
        ("A", 2016, 5): 0, ("B", 2016, 5): 1, ("C", 2016, 5): 0,
    }
    missing = table(occ.detection_grid(images, PIG, 0.5, "month", missing_site=None))
    assert missing[("B", 2015, 1)] is None and missing[("A", 2015, 1)] == 1
    wide = reshape.widen(occ.detection_grid(images, PIG, 0.5, "month"), "month")
    assert wide.columns == ["camID", "2015_month_1", "2016_month_2"]
    assert table(reshape.lengthen(wide)) == table(occ.detection_grid(images, PIG, 0.5, "month"))


def test_zero_grid_runs_from_first_set_date_to_last_photo(spark):
    images = photos(
        spark,
        [("A", PIG, 0.9, "2015-03-01T10:00"), ("A", 1, 0.9, "2016-06-01T10:00"), ("B", 1, 0.9, "2017-08-20T10:00")],
    )
    deployments = sites(spark, [("A", "2015-02-10"), ("B", "2015-03-01"), ("Z", "2015-04-01")])
    got = table(occ.occupancy(images, deployments, PIG, 0.5, "week", mask=False))
    weeks = {y: sorted({i for (_, yy, i) in got if yy == y}) for y in (2015, 2016, 2017)}
    assert weeks == {2015: list(range(6, 53)), 2016: list(range(1, 53)), 2017: list(range(1, 35))}
    assert {c for c, _, _ in got} == {"A", "B", "Z"}
    assert sum(got.values()) == 1 and got[("A", 2015, 9)] == 1


def test_detection_outside_the_period_stays(spark):
    images = photos(spark, [("A", PIG, 0.9, "2015-01-02T10:00"), ("A", PIG, 0.9, "2015-12-31T10:00"), ("A", 1, 0.9, "2016-01-02T10:00")])
    deployments = sites(spark, [("A", "2015-06-01")])
    got = table(occ.occupancy(images, deployments, PIG, 0.5, "week", mask=False))
    assert {i for (_, y, i) in got if y == 2015} == {1, *range(22, 54)}


def limits(spark, start, end, grain="week"):
    images = photos(
        spark,
        [
            ("A", PIG, 0.9, "2015-01-01T00:00"),
            ("A", 1, 0.9, "2016-12-20T00:00"),
            ("B", PIG, 0.9, start),
            ("B", PIG, 0.9, end),
        ],
    )
    deployments = sites(spark, [("A", "2015-01-01"), ("B", "2015-01-01")])
    got = table(occ.occupancy(images, deployments, PIG, 0.5, grain))
    return sorted((y, i) for (c, y, i), v in got.items() if c == "B" and v is None)


def test_mask_start(spark):
    last = "2016-12-20T00:00"
    assert limits(spark, "2015-01-08T00:00", last) == []  # exactly one week late
    assert limits(spark, "2015-01-18T12:00", last) == [(2015, 1), (2015, 2), (2015, 3)]  # 2.5 weeks: 2, plus 1
    assert limits(spark, "2015-01-25T12:00", last) == [(2015, i) for i in range(1, 6)]  # 3.5 weeks: 4, plus 1
    other_year = limits(spark, "2016-01-09T00:00", last)
    assert other_year[-1] == (2016, 2) and len(other_year) == 54


def test_mask_end(spark):
    first = "2015-01-01T00:00"
    assert limits(spark, first, "2016-12-13T00:00") == []  # exactly one week early
    blank = limits(spark, first, "2016-03-05T00:00")
    assert blank[0] == (2016, 10) and blank[-1] == (2016, 51)
    assert limits(spark, first, "2016-12-18T23:00", "day") == [(2016, 353), (2016, 354), (2016, 355)]


def test_guards(spark):
    images = photos(spark, [("A", PIG, 0.9, "2015-01-01T10:00")])
    deployments = sites(spark, [("A", "2015-01-01")])
    with pytest.raises(ValueError):
        occ.occupancy(images, deployments, PIG, 0.5, "month")
    with pytest.raises(ValueError):
        occ.detection_grid(images, PIG, 0.5, "year")
    with pytest.raises(ValueError):
        occ.occupancy(images, deployments.withColumn("SetDate", F.lit("x")), PIG, 0.5, "week")


@pytest.fixture(scope="module")
def random_study(spark):
    rng = random.Random(11)
    rows = []
    for cam in range(12):
        first = dt.datetime(2015, 1, 3) + dt.timedelta(days=rng.randrange(420), hours=rng.randrange(24))
        for _ in range(40):
            t = first + dt.timedelta(hours=rng.randrange(24 * 400))
            rows.append((f"C{cam}", rng.choice([PIG, PIG, 1]), rng.randrange(101) / 100, t.isoformat()))
    # week 53 and a photo before the first set date exist only at some thresholds
    rows += [("C1", PIG, 0.6, "2015-12-31T05:00"), ("C2", PIG, 0.55, "2015-01-02T05:00")]
    deployments = sites(spark, [(f"C{i}", "2015-02-01") for i in range(11)] + [("D", "2015-03-01")])
    return photos(spark, rows), deployments


def test_steps_equal_the_single_pass(spark, random_study):
    images, deployments = random_study
    grid = occ.detection_grid(images, PIG, 0.5, "week")
    steps = occ.mask_inactive(occ.zero_complete(grid, deployments, images, "week"), images, "week")
    assert table(steps) == table(occ.occupancy(images, deployments, PIG, 0.5, "week"))


@pytest.mark.parametrize("with_deployments", [True, False])
def test_sweep_equals_a_loop(spark, random_study, with_deployments):
    images, deployments = random_study
    levels = sweeps.thresholds(0.51, 0.06, 8)

    def total(t):
        if with_deployments:
            full = occ.occupancy(images, deployments, PIG, t, "week")
        else:
            full = occ.mask_inactive(occ.detection_grid(images, PIG, t, "week"), images, "week")
        return full.agg(F.sum("occ")).first()[0]

    base = total(0.5)
    got = sweeps.occupancy_sweep(images, deployments if with_deployments else None, PIG, "week", 0.5, 0.51, 0.06, 8)
    got = {r.threshold: (r.occ_total, r.occ_int_changed) for r in got.collect()}
    assert got == {t: (total(t), base - total(t)) for t in levels}


def test_thresholds_below_is_exact(spark):
    for start, step, n in [(0.2, 0.01, 80), (0.5, 0.01, 51), (0.01, 0.01, 99)]:
        levels = sweeps.thresholds(start, step, n)
        values = sorted({v + d for v in [*levels, 0.0, 1.0, 0.1234] for d in (-1e-12, 0.0, 1e-12)})
        values += [float("inf"), float("-inf"), float("nan"), None, -5.0, 5.0]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [r[1] for r in df.select("v", sweeps.thresholds_below(F.col("v"), start, step, n)).collect()]
        assert got == [0 if v is None or v != v else sum(v > t for t in levels) for v in values]


def test_retention(spark):
    images = spark.createDataFrame(
        [(PIG, 0.3, "a"), (PIG, 0.9, "a"), (PIG, 0.5, "b"), (PIG, None, None), (1, 0.95, "b")],
        "GUESS1 int, CONFIDENCE1 double, cam_chk_burst string",
    )
    kept = {(r.species, round(r.threshold, 2)): (r.kept, r.total) for r in sweeps.image_retention(images).collect()}
    assert kept[("all", 0.2)] == (4, 5) and kept[("pig", 0.5)] == (1, 4) and kept[("cattle", 0.95)] == (0, 1)
    bursts = sorted((r.threshold, r.prop_retained) for r in sweeps.burst_retention(images).collect())
    assert bursts[0] == (0.5, 1 / 3) and len(bursts) == 51
    assert all(a[1] >= b[1] for a, b in zip(bursts, bursts[1:]))


@pytest.fixture(scope="module")
def store(spark, random_study, tmp_path_factory):
    images, _ = random_study
    store = cellstore.CellStore(str(tmp_path_factory.mktemp("cells") / "all"))
    odd = F.pmod(F.xxhash64("camID", "DateTimeOriginal"), F.lit(2)) == 1
    store.add(images.where(odd).withColumn("GUESS1", F.lit(PIG)), "1")  # wrong, and replaced by the next
    store.add(images.where(odd), "1")
    store.add(images.where(~odd), "2")
    store.add(images, "again")  # what is there twice changes nothing
    store.add(images.where("false"), "none")
    return store


@pytest.mark.parametrize("time_int", ["day", "week"])
def test_store_equals_images(spark, random_study, store, time_int):
    images, deployments = random_study
    got = store.occupancy(spark, deployments, PIG, 0.5, time_int)
    assert table(got) == table(occ.occupancy(images, deployments, PIG, 0.5, time_int))
    assert all("/check=" in f for f in got.inputFiles())  # stored cells, not the images
    year = occ.occupancy(occ.year_images(images, 2016), deployments, 1, None, time_int)
    assert table(store.occupancy(spark, deployments, 1, None, time_int, year=2016)) == table(year)
    swept = sweeps.occupancy_sweep(images, deployments, PIG, time_int, 0.5, 0.51).collect()
    assert sorted(store.occupancy_sweep(spark, deployments, PIG, time_int, 0.5, 0.51).collect()) == sorted(swept)


def test_store_tables(spark, random_study, store):
    images, deployments = random_study
    got = store.tables(spark, deployments, (PIG, 1), 0.3, ("week", "month")).collect()
    for species in (PIG, 1):
        for g in ("week", "month"):
            own = {(r.camID, r.year, r.interval): r.occ for r in got if (r.species, r.time_int) == (species, g)}
            if g == "month":
                assert own == table(occ.detection_grid(images, species, 0.3, g))
            else:
                assert own == table(occ.occupancy(images, deployments, species, 0.3, g))


def test_store_odd_rows(spark, tmp_path):
    rows = [(None, PIG, 0.9, "2015-01-01T10:00"), ("A", None, 0.9, "2015-01-02T10:00"), ("A", PIG, float("nan"), "2015-01-03T10:00"), ("A", PIG, None, "2015-01-03T11:00")]
    store = cellstore.CellStore(str(tmp_path / "cells"))
    store.add(photos(spark, rows).withColumns({"best": F.lit("x"), "year": F.lit("y")}), "a.1")
    cells = sorted(store.cells(spark, PIG, "day").collect())
    assert [(c.camID, c.code, c.best) for c in cells] == [("A", 20150002, None), ("A", 20150003, float("-inf"))]
    with pytest.raises(ValueError):
        store.cells(spark, PIG, "hour")
    with pytest.raises(ValueError):
        store.add(photos(spark, rows), "a/b")
    with pytest.raises(ValueError):
        cellstore.CellStore("x", "week")


def plan_of(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_tables_are_one_pass_in_many_tasks(spark, random_study, store):
    _, deployments = random_study
    got = store.tables(spark, deployments, (PIG, 1, 15), 0.3, ("day", "week", "month"))
    assert "FileScan" not in plan_of(got)  # the stored rows were read before, once for all tables
    day = got.where((F.col("species") == PIG) & (F.col("time_int") == "day"))
    assert day.select(F.spark_partition_id()).distinct().count() > 1  # small cameras are not put together before they are expanded
    assert store.tables(spark, deployments.where("false"), (PIG,), 0.3, ("week",)).count() == 0


def test_mask_neither_sorts_the_long_table_nor_groups_photos_without_a_detection(spark, random_study):
    images, _ = random_study
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(occ.mask_inactive(occ.detection_grid(images, PIG, 0.9, "day"), images, "day"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    groups = occ._hits(images, PIG, 0.9, occ.GRAINS["day"], "DateTimeOriginal")
    seen = images.where((F.col("GUESS1") == PIG) & (F.col("CONFIDENCE1") > 0.9))
    years = images.select("camID", F.year("DateTimeOriginal")).distinct().count()
    assert groups.count() <= years + seen.count()
    assert occ.grid_of(occ.cells(images, PIG, occ.GRAINS["day"]), 0.9).count() == occ.detection_grid(images, PIG, 0.9, "day").count()


def test_wide_lines(spark, tmp_path):
    rows = [("A", 2015, 0, 1), ("A", 2016, 8783, None), ('B, "b"', 2015, 0, 0), (" c ", 2016, 8783, 1), (" c ", 2016, 8783, 0), ("A", 2015, 30, 0)]
    long = spark.createDataFrame(rows, "camID string, year int, interval int, occ int")
    writers.write_wide(long, str(tmp_path / "wide"), "hour")
    lines = [x for f in sorted((tmp_path / "wide").glob("*.csv")) for x in f.read_text().splitlines()]
    assert set(lines) == {"camID,2015_hour_0,2015_hour_30,2016_hour_8783", "A,1,0,NA", '"B, ""b""",0,NA,NA', " c ,NA,NA,1"}
    got = table(readers.read_wide(spark, str(tmp_path / "wide")))
    assert len(got) == 9 and got[("A", 2015, 30)] == 0 and got[('B, "b"', 2015, 0)] == 0 and got[(" c ", 2016, 8783)] == 1
    assert got[("A", 2016, 8783)] is None
    plan = reshape.camera_lines(long, "hour")._jdf.queryExecution().toString()
    assert "pivot" not in plan.lower()
    with pytest.raises(Exception, match="several lines"):
        reshape.camera_lines(long.withColumn("camID", F.lit("a\nb")), "hour").collect()


def test_wide_table_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "camID string, year int, interval int, occ int")
    writers.write_wide(none, str(tmp_path / "wide"), "hour")
    assert reshape.camera_lines(none, "hour").columns == ["camID"] and reshape.camera_lines(none, "hour").count() == 0
