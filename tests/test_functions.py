import datetime as dt

import pytest
from pyspark.sql import functions as F

from trapgrid.functions import clock, labels, sun, text
from trapgrid.operators import reshape


def one(spark, schema, values, *columns):
    return spark.createDataFrame([values], schema).select(*columns).first()


def value(spark, literal, build):
    return one(spark, "x string", (literal,), build(F.col("x")))[0]


@pytest.mark.parametrize(
    "given, n, want",
    [("a/b/c", 2, "b"), ("a/b/c", 4, None), ("/a/b", 1, ""), ("a//b", 2, ""), ("a/b/", 3, None), ("", 1, None), (None, 1, None)],
)
def test_piece(spark, given, n, want):
    assert value(spark, given, lambda x: text.piece(x, "/", n)) == want


def test_paste_writes_missing_as_text(spark):
    assert value(spark, "short.jpg", labels.photo_db_key) == "NA_NA"
    assert value(spark, "FL-01_06_01_2015_FL-01_0000001.jpg", labels.photo_db_key) == "FL-01_0000001.jpg"


def test_names(spark):
    assert value(spark, 'a/b/c.jpg"', lambda x: text.drop_last_char(text.basename(x))) == "c.jpg"
    assert value(spark, "c.jpg", text.basename) == "c.jpg"
    assert value(spark, "", text.drop_last_char) == ""
    assert value(spark, "TAG - 3", text.strip_spaces) == "TAG-3"
    assert value(spark, "2015_week_7", text.last_suffix) == "7"
    assert value(spark, "2015_week_7", lambda x: text.count_char(x, "_")) == 2
    assert value(spark, "Red Deer", lambda x: text.recode(x, {"Red Deer": "Elk"})) == "Elk"


# Worked path examples with study and key.
PATHS = [
    ("resized_NWRC/WA-Site8_02997.JPG", "NWRC", "WA-Site8_02997.JPG"),
    (
        "resized_disk4_empty/Pooled_Images/10/ACAM202_100RECNX_IMG_0041.JPG",
        "SREL",
        "ACAM202_100RECNX_IMG_0041.JPG",
    ),
    ("resized_CPW/23/2015_Unit112_Cam069_img0437.jpg", "CPW", "2015_Unit112_Cam069_img0437.jpg"),
    ("resized_1218/63/CA-37_08_03_2015_CA-37_0006618.jpg", "CA", "CA-37_0006618.jpg"),
    ("resized_1918/1/FL-28_07_28_2015_FL-28_0018595.jpg", "FL", "FL-28_0018595.jpg"),
]


@pytest.mark.parametrize("path, study, key", PATHS)
def test_study_and_key(spark, path, study, key):
    label = labels.study_label(F.col("x"), "CA")
    got = one(spark, "x string", (path,), label.alias("s"), labels.filename_key(F.col("x"), label).alias("k"))
    assert tuple(got) == (study, key)
    if study != "NWRC":
        assert value(spark, f"/scratch/sets/run/{path}", lambda x: labels.filename_key(x, F.lit(study), "result")) == key


def test_study_of_other_paths(spark):
    assert value(spark, None, labels.study_label) == "flag"
    assert value(spark, "x/y.jpg", labels.study_label) == "flag"
    assert value(spark, "x/TAG-1.jpg", labels.study_label) == "TAG"
    assert value(spark, "x/TAG-1.jpg", lambda x: labels.study_label(x, "CA")) == "CA"
    assert value(spark, "cpw/y.jpg", labels.study_label) == "flag"
    with pytest.raises(ValueError):
        labels.filename_key(F.col("x"), F.col("s"), "other")


@pytest.mark.parametrize("day, week", [("2016-01-01", 1), ("2016-01-07", 1), ("2016-01-08", 2), ("2016-12-31", 53)])
def test_week_rule(spark, day, week):
    assert value(spark, day, lambda x: clock.week_of_year(x.cast("date"))) == week


@pytest.mark.parametrize(
    "given, want",
    [
        ("2015:08:18 02:30:59", dt.datetime(2015, 8, 18, 2, 30, 59)),
        ("0000:00:00 00:00:00", None),
        ("2015:02:30 00:00:00", None),
        ("2015:08:18", None),
        ("", None),
        (None, None),
    ],
)
def test_photo_time(spark, given, want):
    assert value(spark, given, clock.parse_photo_time) == want


def test_dates(spark):
    assert value(spark, "18-Aug-15", clock.parse_set_date) == dt.date(2015, 8, 18)
    assert value(spark, "8-AUG-95", clock.parse_set_date) == dt.date(1995, 8, 8)
    assert value(spark, "soon", clock.parse_set_date) is None
    assert value(spark, "8/18/2015", clock.parse_slash_date) == dt.date(2015, 8, 18)
    assert value(spark, "2015-08-18 10:11:12", clock.parse_iso_date) == dt.date(2015, 8, 18)


def test_zone_and_elapsed_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        wall = clock.parse_photo_time(F.col("x"))
        got = value(spark, "2015:07:01 02:00:00", lambda x: clock.to_utc(clock.parse_photo_time(x), "US/Pacific"))
        assert got == dt.datetime(2015, 7, 1, 9)
        micros = one(spark, "x string", ("2015:03:08 02:30:01",), clock.epoch_micros(wall))[0]
        assert micros == int(dt.datetime(2015, 3, 8, 2, 30, 1, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    week = value(
        spark, "2015:01:18 12:00:00",
        lambda x: clock.elapsed(clock.parse_photo_time(x), F.lit("2015-01-01").cast("date"), "week"),
    )
    assert week == 2.5


def test_sun_times(spark):
    rise, sink = sun.sun_times(F.col("x").cast("date"), F.lit(34.9), F.lit(-118.7))
    got = one(spark, "x string", ("2015-08-18",), rise, sink)
    at = [dt.datetime.fromtimestamp(v / 1e6, dt.timezone.utc).replace(microsecond=0, tzinfo=None) for v in got]
    assert at == [dt.datetime(2015, 8, 18, 13, 21, 15), dt.datetime(2015, 8, 19, 2, 38, 59)]
    polar = sun.sun_times(F.col("x").cast("date"), F.lit(80.0), F.lit(0.0))
    assert list(one(spark, "x string", ("2015-06-21",), *polar)) == [None, None]


def test_day_or_night(spark):
    def label(t):
        wall = clock.parse_photo_time(F.col("x"))
        column = sun.day_or_night(clock.to_utc(wall, "US/Pacific"), F.to_date(wall), F.lit(34.9), F.lit(-118.7))
        return one(spark, "x string", (t,), column)[0]

    times = ["2015:08:18 06:21:14", "2015:08:18 06:21:16", "2015:08:18 19:38:58", "2015:08:18 19:39:00", None]
    assert [label(t) for t in times] == ["night", "day", "day", "night", None]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "guess1 int, fileName int, x int")
    assert reshape.title_case_names(df).columns == ["Guess1", "Filename", "X"]


def test_grain_guard():
    with pytest.raises(ValueError):
        clock.grain("month", ("day", "week"))
