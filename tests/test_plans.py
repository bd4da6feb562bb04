import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from trapgrid import schemas
from trapgrid.operators import joins, ranking
from trapgrid.plans import daynight, exchange, images as assembly, reports
from trapgrid.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def predictions(spark, paths):
    data = [(i, p, 22, 0.5 + i / 10) for i, p in enumerate(paths)]
    return assembly.label_predictions(spark.createDataFrame(data, "ROW_NUM int, IMG_PATH string, GUESS1 int, CONFIDENCE1 double"))


def test_burst_keys_restart_per_file(spark):
    meta = spark.createDataFrame(
        [("f1", "d2", "CA-1_1.jpg", 7), ("f1", "d1", "CA-1_2.jpg", 7), ("f2", "d2", "CA-2_1.jpg", None)],
        "SourceCSV string, Directory string, FileName string, EventNumber int",
    )
    keys = {r.FileName: r.cam_chk_burst for r in assembly.add_burst_key(meta).collect()}
    assert keys == {"CA-1_1.jpg": "CA-1_2_7", "CA-1_2.jpg": "CA-1_1_7", "CA-2_1.jpg": "CA-2_1_NA"}


def test_image_table(spark):
    preds = predictions(spark, ["a/b/FL/FL-1_1.jpg", "a/b/CA-/CA-1_1.jpg", "a/b/FL/FL-9_9.jpg", "short.jpg"])
    meta = spark.createDataFrame(
        [("d", "FL-1_1.jpg", "2015:07:01 02:00:00"), ("d", "CA-1_1.jpg", "0000:00:00 00:00:00"), ("d", "CA-1_1.jpg", "2015:12:31 23:00:00"), ("d", None, None)],
        schemas.PLAIN_METADATA,
    )
    got = assembly.image_table(preds, meta).select("FileName", "study", "camID", F.col("DateTimeUTC").cast("string"), "week", "yday", "day")
    assert rows(got) == [
        ("CA-1_1.jpg", "CA", "CA-1", "2016-01-01 07:00:00", 53, 365, 31),
        ("FL-1_1.jpg", "FL", "FL-1", "2015-07-01 06:00:00", 26, 182, 1),
    ]


def test_burst_filter_keeps_low_images_of_good_bursts(spark):
    images = spark.createDataFrame([("a", 0.1), ("a", 0.96), ("b", 0.94), (None, 0.2), (None, 0.97)], "cam_chk_burst string, CONFIDENCE1 double")
    assert rows(assembly.burst_filtered(images, 0.9499)) == sorted(
        [("a", 0.1, 0.96, 0.1), ("a", 0.96, 0.96, 0.1), (None, 0.2, 0.97, 0.2), (None, 0.97, 0.97, 0.2)], key=repr
    )
    assert assembly.with_burst_extremes(images).count() == 5


def test_species_tally(spark):
    results = spark.createDataFrame([("CPW/1", 4), ("CPW/2", 4), ("CPW/3", 9), ("CPW/4", 2), ("x", 99)], "imageID string, answer int")
    cats = spark.createDataFrame([(4, "Red Deer"), (9, "Opossum"), (2, "Quail")], schemas.CATEGORIES)
    assert rows(reports.species_tally(results, cats)) == [
        ("CPW", 2, 1, "Quail", 2), ("CPW", 4, 2, "Elk", 1), ("CPW", 9, 1, "Opossum", 3), ("flag", 99, 1, None, 1),
    ]


def test_photo_db_merge(spark):
    export = spark.createDataFrame(
        [("FL-01_06_01_2015_FL-01_0000001.jpg", "u1", "s1"), ("FL-01_06_01_2015_FL-01_0000002.jpg", "u2", None), ("x.jpg", "u3", "s3")],
        "filename string, UnkID string, speciesID string",
    )
    preds = spark.createDataFrame(
        [(1, "FL-01_0000001.jpg", "d", 22), (2, "FL-01_0000002.jpg", "d", 1), (3, "FL-01_0000001.jpg", None, 15)],
        "X1 int, filename string, Directory string, GUESS1 int",
    )
    assert rows(exchange.merge_photo_db(export, preds)) == [
        ("FL-01_06_01_2015_FL-01_0000001.jpg", "u1", "s1", "FL-01_0000001.jpg", 22)
    ]


def test_crosswalk_has_no_code_twice(spark):
    named = exchange.add_database_names(spark.createDataFrame([(22,), (0,), (None,)], "GUESS1 int"))
    assert rows(named) == sorted([(22, "Wild Pig", "Sus scrofa"), (0, None, None), (None, None, None)], key=repr)
    assert exchange.crosswalk(spark).select("ml_code").distinct().count() == 17


def test_import_conversion_joins_within_a_camera(spark):
    output = spark.createDataFrame(
        [("FL01", 1, 'p/x.jpg"', 3, 22, 0.9), ("FL02", 1, 'p/x.jpg"', 3, 15, 0.8)],
        "camera string, X1 int, fileName string, answer int, guess1 int, confidence1 double",
    )
    ids = spark.createDataFrame([("FL01", "i1", "x.jpg"), ("FL02", "i2", "x.jpg"), ("FL02", "i3", "y.jpg")], "camera string, ImageID string, FileName string")
    got = exchange.to_import(output, ids)
    assert got.columns == ["camera", "ImageID", "FileName", "Guess1", "Confidence1"]
    assert rows(got) == [("FL01", "i1", "x.jpg", 22, 0.9), ("FL02", "i2", "x.jpg", 15, 0.8), ("FL02", "i3", "y.jpg", None, None)]


def test_file_manifest(spark):
    wanted = spark.createDataFrame([("CA-01_0006500.jpg",), ("none.jpg",)], "name string")
    listing = spark.createDataFrame([("CA-01/02_11_2016/CA-01_0006500.jpg", 1), ("short.jpg", 1)], "path string, length long")
    assert rows(exchange.file_manifest(wanted, listing, 3)) == [
        ("CA-01_0006500.jpg", "CA-01/02_11_2016/CA-01_0006500.jpg", "CA-01/02_11_2016", True),
        ("none.jpg", None, None, False),
    ]


def test_day_night_results(spark):
    results = spark.createDataFrame(
        [("/scratch/sets/run/resized_1218/63/CA-37_08_03_2015_CA-37_0017365.jpg", 1), ("resized_NWRC/WA_1.JPG", 2)], "imageID string, answer int"
    )
    photos = spark.createDataFrame(
        [("s", "CA-37_0017365.jpg", "2015:08:18 12:00:00", "CA"), ("s", "CA-37_0017365.jpg", None, "CA")],
        "SourceFile string, FileName string, DateTimeOriginal string, study string",
    )
    labelled = daynight.label_day_night(photos, 34.9, -118.7, "US/Pacific")
    got = daynight.day_night_results(results, labelled).select("trim", "study", "daynight")
    assert rows(got) == [("CA-37_0017365.jpg", "CA", "day")]


def test_files(spark, tmp_path):
    root = str(tmp_path)
    meta = spark.createDataFrame([("d", "a_1.jpg", "2015:01:01 00:00:00", 1, None)], schemas.BURST_METADATA)
    extra = meta.select(F.lit("junk").alias("Other"), *reversed(meta.columns))
    writers.write_table(extra, f"{root}/meta")
    assert rows(readers.read_table(spark, f"{root}/meta", schemas.BURST_METADATA)) == rows(meta)
    scanned = readers.read_metadata_folder(spark, f"{root}/meta").first()
    assert scanned.FileName == "a_1.jpg" and scanned.SourceCSV.endswith(".csv")
    writers.write_indexed(spark.createDataFrame([("b",), ("a",)], "x string"), f"{root}/indexed", ["x"])
    assert rows(readers.read_table(spark, f"{root}/indexed", "X1 int, x string")) == [(1, "a"), (2, "b")]
    cams = spark.createDataFrame([("FL01", "i1", "x.jpg"), ("FL02", "i2", "y.jpg")], "camera string, ImageID string, FileName string")
    writers.write_per_camera(cams, f"{root}/out", 3)
    files = [r.path for r in readers.list_files(spark, f"{root}/out").collect() if r.path.endswith(".csv")]
    assert sorted(f.split("/part")[0] for f in files) == ["camera=FL01/check_num=3", "camera=FL02/check_num=3"]
    for cam in ("FL01", "FL02"):
        (tmp_path / "cams" / cam).mkdir(parents=True)
        (tmp_path / "cams" / cam / f"{cam}_check1_clean_out.csv").write_text('X1,fileName,answer\n1,"a/b.jpg",4\n')
    clean = readers.read_camera_folders(spark, f"{root}/cams", "*_clean_out.csv", "fileName string, answer int")
    assert rows(clean) == [("a/b.jpg", 4, "FL01", None), ("a/b.jpg", 4, "FL02", None)]
    back = readers.read_camera_folders(spark, f"{root}/out", "*.csv", schemas.IMPORT_TABLE)
    assert rows(back) == [("i1", "x.jpg", "FL01", "3"), ("i2", "y.jpg", "FL02", "3")]
    listing = spark.createDataFrame([("a b/c.jpg", 5), ("d", None)], "path string, length long")
    writers.write_listing(listing, f"{root}/listing")
    assert rows(readers.read_listing(spark, f"{root}/listing")) == [("a b/c.jpg", 5), ("d", None)]


def test_exported_metadata_keeps_three_columns(spark, tmp_path):
    (tmp_path / "out.csv").write_text("SourceFile,FileSize,FileName,DateTimeOriginal\nd/a.jpg,9,a.jpg,2015:01:01 00:00:00\n")
    got = readers.read_exported_metadata(spark, str(tmp_path))
    assert rows(got) == [("d/a.jpg", "a.jpg", "2015:01:01 00:00:00")]


def test_quality_report(spark):
    preds = predictions(spark, ["a/b/FL/FL-1_1.jpg", "a/b/FL/FL-1_2.jpg", "short.jpg"])
    meta = spark.createDataFrame(
        [("d", "FL-1_1.jpg", "0000:00:00 00:00:00"), ("d", "FL-1_1.jpg", None)], schemas.PLAIN_METADATA
    )
    found = meta.where("DateTimeOriginal is not null").drop("Directory").withColumn("found", F.lit(True))
    undated = spark.createDataFrame([("FL-1_2.jpg", None, True)], found.schema)
    joined = preds.select("FileName").join(found.union(undated), "FileName", "left")
    joined = joined.withColumn("photo_time", F.lit(None).cast("timestamp_ntz"))
    got = {(r.check, r.column): r.value for r in reports.quality_report(preds, meta, joined).collect()}
    assert got[("missing", "FileName")] == 1 and got[("missing_metadata", "DateTimeOriginal")] == 1
    assert got[("unmatched", "FileName")] == 1 and got[("unreadable", "DateTimeOriginal")] == 1
    assert got[("undated", "DateTimeOriginal")] == 1 and got[("nameless", "FileName")] == 0
    assert got[("duplicates", "FileName")] == 1 and got[("length", "19")] == 1
    assert got[("rows", "FL")] == 2 and got[("rows", "flag")] == 1


def test_columns_are_found_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"say ""hi"", a.jpg"\nNA,\n')
    (tmp_path / "b.csv").write_text('"y","more, or less",x\r\nNA,5,2\r\n')
    assert rows(readers.read_table(spark, str(tmp_path), "x int, y string")) == sorted([(1, 'say "hi", a.jpg'), (None, None), (2, None)], key=repr)
    with pytest.raises(Exception, match="lacks"):
        readers.read_table(spark, str(tmp_path), "x int, z string")
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path), "x int, y string", one_header=True).collect()


def test_any_number_of_headers(spark, tmp_path):
    """1,100 different headers: more than one scan for each, every file counts, and one without the column is told."""
    for i in range(1100):
        names = [f"n{i}", *[f"f{k}" for k in range(i % 20)]]
        (tmp_path / f"{i}.csv").write_text(",".join([*names, "x"]) + "\n" + "0," * len(names) + f"{i}\n")
    assert sorted(r.x for r in readers.read_table(spark, str(tmp_path), "x int").collect()) == list(range(1100))
    (tmp_path / "last.csv").write_text("z,y\n1,2\n")
    with pytest.raises(ValueError, match="last.csv.*lacks"):
        readers.read_table(spark, str(tmp_path), "x int")


def test_records_over_several_lines(spark, tmp_path):
    texts = ["one\ntwo", " outer ", "a\r\nb", 'q "in\nner" q', "plain", None, "x,\n,y"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    writers.write_table(table, f"{tmp_path}/out")
    for one in (False, True):
        got = {r.k: r.t for r in readers.read_table(spark, f"{tmp_path}/out", "t string, k int", one_header=one).collect()}
        assert got == dict(enumerate(texts))
    # A file too large to be read whole is split, and a record over several lines an error instead of two wrong rows.
    with pytest.raises(Exception, match="several lines"):
        readers._by_name(spark, f"{tmp_path}/out", "t string, k int", {}, whole_up_to=1).collect()
    writers.write_table(table.where("k in (1, 4)"), f"{tmp_path}/flat")
    flat = readers._by_name(spark, f"{tmp_path}/flat", "t string, k int", {}, whole_up_to=1).collect()
    assert sorted((r.k, r.t) for r in flat) == [(1, " outer "), (4, "plain")]
    (tmp_path / "bare.csv").write_text('1,"a\nb"\n2,c\n')
    assert rows(readers.read_headerless(spark, f"{tmp_path}/bare.csv", "k int, t string")) == [(1, "a\nb"), (2, "c")]


def test_counts_of_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y,z\n1,2.5,a\nNA,no,b\nseven,,c\n")
    (tmp_path / "in" / "b.csv").write_text("z,y,x\nd,1e,9\n")
    watch = Observation("read")
    writers.write_table(readers.read_table(spark, f"{tmp_path}/in", "x int, y double, z string", watch=watch), f"{tmp_path}/out")
    assert watch.get == {"x": 1, "y": 2, "z": 0}


def test_named_files(spark, tmp_path):
    table = spark.createDataFrame([(f"C{i % 3}", i, None if i == 4 else f'f"{i}, \n') for i in range(30)] + [(None, 99, "x")], "camera string, n int, t string")
    writers.write_named(table, str(tmp_path), 2)
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file()) == [*[f"C{k}/C{k}_check2_to_import.csv" for k in range(3)], "NA/NA_check2_to_import.csv"]
    back = readers.read_camera_folders(spark, str(tmp_path), "*_to_import.csv", "n int, t string").collect()
    assert sorted((r.camera, r.n, r.t) for r in back) == sorted([(f"C{i % 3}", i, None if i == 4 else f'f"{i}, \n') for i in range(30)] + [("NA", 99, "x")])
    # A task that fails leaves the files that were there, and nothing half written.
    bad = table.withColumn("n", F.when(F.col("n") == 29, F.raise_error(F.lit("broken"))).otherwise(F.col("n") + 1))
    with pytest.raises(Exception, match="broken"):
        writers.write_named(bad.withColumn("t", F.concat("t", F.col("n").cast("string"))), str(tmp_path), 3)
    assert not list(tmp_path.rglob("*check3*")) and not list(tmp_path.glob("_waiting*"))
    assert len(list(tmp_path.rglob("*.csv"))) == 4


def test_camera_files_as_spark_writes_them(spark, tmp_path):
    texts = ['say "hi", a.jpg', "two\nlines", "", None, " blanks ", "NA", "é#\\x", '"']
    cameras = ["FL 01", "é", None, "", "a/b=c%:'{}^+", "x\ty"]
    rows = [(c, t, i, i / 3, datetime.date(2020, 1, 1 + i), datetime.datetime(2020, 1, 1, 3, 4, i)) for c in cameras for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "camera string, t string, `a,b` int, d double, day date, at timestamp").repartition(3)
    writers.write_per_camera(table, f"{tmp_path}/own", 2)
    told = table.withColumn("check_num", F.lit(2)).repartition("camera").write.options(**writers._FORM)
    told.partitionBy("camera", "check_num").csv(f"{tmp_path}/sparks")

    def lines(folder):
        return {str(f.parent.relative_to(folder)): sorted(f.read_text().split("\n")) for f in folder.rglob("part-*.csv")}

    assert lines(tmp_path / "own") == lines(tmp_path / "sparks") and (tmp_path / "own" / "_SUCCESS").exists()
    # No file was made by Hadoop's local file system, which keeps a checksum file and starts processes for each.
    assert not list((tmp_path / "own").rglob("*.crc")) and not list((tmp_path / "own").rglob("_waiting*"))
    back, sparks = (readers.read_camera_folders(spark, f"{tmp_path}/{name}", "*.csv", "t string, d double") for name in ("own", "sparks"))
    assert sorted(map(str, back.collect())) == sorted(map(str, sparks.collect())) and back.count() == len(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_per_camera(table, f"{tmp_path}/own", 2)
    writers.write_per_camera(table, f"file://{tmp_path}/own", 2, mode="append")
    writers.write_per_camera(table, f"{tmp_path}/own", 3, mode="append")
    assert readers.read_camera_folders(spark, f"{tmp_path}/own", "*.csv", "t string").groupBy("check_num").count().sort("check_num").collect() == [("2", 2 * len(rows)), ("3", len(rows))]
    bad = table.withColumn("t", F.when(F.col("d") > 2, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        writers.write_per_camera(bad, f"{tmp_path}/broken", 2)
    assert not list((tmp_path / "broken").rglob("*"))


def test_many_camera_folders_are_listed_by_few_tasks(spark, tmp_path):
    name, group = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "many folders"
    before, most = spark.conf.get(name), 8 * spark.sparkContext.defaultParallelism
    for i in range(most + 8):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "a.csv").write_text(f"n\n{i}\n")
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = readers.read_camera_folders(spark, str(tmp_path), "*.csv", "n int").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.n, r.camera, r.check_num) for r in found) == [(i, f"c{i}", None) for i in range(most + 8)]
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) == most and spark.conf.get(name) == before


def test_lines_in_the_order_of_the_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("k,v\n" + "".join(f"{i % 7},{i}\n" for i in range(500)))
    (tmp_path / "d" / "b.csv").write_text("v,k\n" + "".join(f"{i},{i % 9}\n" for i in range(500, 900)))
    found = readers.read_table(spark, f"{tmp_path}/d", "k int, v int", position="at")
    first = joins.first_per_key(found, ["k"], ["at"]).collect()
    assert {r.k: r.v for r in first} == {**{k: min(v for v in range(500, 900) if v % 9 == k) for k in (7, 8)}, **{k: k for k in range(7)}}
    numbered = ranking.with_line_number(found, "at", "n").collect()
    assert sorted((r.n, r.v) for r in numbered) == [(i + 1, i) for i in range(900)]
    (tmp_path / "other.csv").write_text("w\n" + "".join(f"w{i}\n" for i in range(900)))
    other = readers.read_table(spark, f"{tmp_path}/other.csv", "w string", position="place")
    bound = ranking.bind_by_line(found, other, "at", "place").collect()
    assert sorted((r.v, r.w) for r in bound) == [(i, f"w{i}") for i in range(900)]
    with pytest.raises(ValueError, match="bound"):
        ranking.bind_by_line(found, other.limit(3), "at", "place")
    # Large files are split: the same order over their blocks.
    blocks = readers._by_name(spark, f"{tmp_path}/d/a.csv", "k int, v int", {"at": readers.line_position()}, whole_up_to=1)
    assert sorted((r.n, r.v) for r in ranking.with_line_number(blocks, "at", "n").collect()) == [(i + 1, i) for i in range(500)]


def test_an_instant_needs_a_known_zone(spark):
    preds = predictions(spark, ["a/b/ACAM/SREL-1_1.jpg"])
    meta = spark.createDataFrame([("d", "SREL-1_1.jpg", "2015:07:01 02:00:00")], schemas.PLAIN_METADATA)
    got = assembly.image_table(preds, meta).first()
    assert got.study == "SREL" and got.DateTimeUTC is None and got.hour == 2
