"""Registered queries: each library operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trapgrid import schemas
from trapgrid.functions import clock, labels, text
from trapgrid.operators import aggregates, joins, ranking, reshape
from trapgrid.plans import cellstore, daynight, exchange, images as assembly, occupancy as occ, reports, sweeps
from trapgrid.session import new_folder
from trapgrid.sources import listing, readers, writers
from trapgrid.verify.views import OVERRIDDEN, OVERRIDE_DATE, table, view

PIG = sweeps.PIG
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _columns(*names: str):
    return [F.col(n) for n in names]


# --- filters and scalars ---------------------------------------------------------------


@query
def species_filter(spark, d):
    return view(spark, d, "images").where(F.col("GUESS1") == PIG).select("FileName", "line", "CONFIDENCE1")


@query
def confidence_filter(spark, d):
    return view(spark, d, "images").where(F.col("CONFIDENCE1") > 0.95).select("FileName", "line", "CONFIDENCE1")


@query
def study_filter(spark, d):
    images = view(spark, d, "images").where(F.col("study") != "FL")
    return occ.year_images(images, 1997).select("FileName", "line", "DateTimeOriginal")


@query
def drop_incomplete(spark, d):
    return view(spark, d, "metadata").dropna("any")


@query
def drop_undated(spark, d):
    return view(spark, d, "metadata").where(F.col("DateTimeOriginal").isNotNull())


@query
def split_piece(spark, d):
    url = F.col("url")
    slashed = F.concat(url, F.lit("/"))
    pieces = {f"piece{n}": text.piece(url, "/", n) for n in range(1, 7)}
    return table(spark, d, "pages").select(
        "page_id", *[c.alias(n) for n, c in pieces.items()], text.piece(slashed, "/", 6).alias("slashed6")
    )


@query
def paste_key(spark, d):
    return view(spark, d, "label_paths").select("imageID", labels.photo_db_key(F.col("imageID")).alias("key"))


@query
def basename_clean(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        text.basename(url).alias("name"),
        text.drop_last_char(text.basename(url)).alias("trimmed"),
        text.last_suffix(url, "=").alias("suffix"),
        text.count_char(url, "/").cast("int").alias("slashes"),
        F.char_length(url).alias("length"),
    )


@query
def title_case(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.title_case(F.col("o_orderpriority")).alias("title"))


@query
def recode_class(spark, d):
    label = text.recode(F.col("o_orderpriority"), {"1-URGENT": "Elk", "5-LOW": "Deer"})
    return table(spark, d, "orders").select("o_orderkey", label.alias("className"))


@query
def calendar_parts(spark, d):
    parts = clock.calendar_parts(F.col("DateTimeOriginal"))
    return view(spark, d, "images").select("FileName", "line", *[c.alias(n) for n, c in parts.items()])


@query
def week_rule(spark, d):
    week = clock.week_of_year(F.col("o_orderdate"))
    orders = table(spark, d, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year"), week.alias("week")).agg(F.count("*").alias("n"))


@query
def parse_exif_time(spark, d):
    wall = clock.parse_photo_time(F.col("DateTimeOriginal"))
    return view(spark, d, "metadata").select(
        "FileName", "Directory", "EventNumber", wall.alias("wall"), F.to_date(wall).alias("day")
    )


@query
def photo_instants(spark, d):
    photos = view(spark, d, "day_photos")
    zone = assembly.site_value(F.col("study"), 2)
    utc = clock.to_utc(clock.parse_photo_time(F.col("DateTimeOriginal")), zone)
    return photos.select("FileName", utc.alias("utc"))


@query
def parse_set_dates(spark, d):
    at = F.col("o_orderdate")
    short, slash, iso = (F.date_format(at, f) for f in ("dd-MMM-yy", "M/d/yyyy", "yyyy-MM-dd"))
    return table(spark, d, "orders").select(
        "o_orderkey",
        clock.parse_set_date(F.upper(short)).alias("short"),
        clock.parse_slash_date(slash).alias("slash"),
        clock.parse_iso_date(iso).alias("iso"),
        clock.parse_slash_date(iso).alias("wrong_format"),
    )


@query
def elapsed_units(spark, d):
    images = view(spark, d, "images")
    first = images.agg(F.min("DateTimeOriginal")).scalar()
    ranges = occ.camera_ranges(images).withColumn("first", first)
    units = [clock.elapsed(F.col("start_date"), F.col("first"), u).alias(u) for u in ("week", "day", "hour")]
    return ranges.select("camID", *units, F.rint(units[0]).cast("int").alias("rounded"))


# --- labels and keys -------------------------------------------------------------------


@query
def study_label_tag(spark, d):
    path = F.col("imageID")
    return view(spark, d, "label_paths").select(path, labels.study_label(path, "TAG").alias("study"))


@query
def study_label_ca(spark, d):
    path = F.col("imageID")
    return view(spark, d, "label_paths").select(path, labels.study_label(path, "CA").alias("study"))


@query
def study_filename_key(spark, d):
    path = F.col("imageID")
    keyed = view(spark, d, "label_paths").select(path, labels.study_label(path, "CA").alias("study"))
    return keyed.withColumn("trim", labels.filename_key(path, F.col("study"), "list"))


@query
def study_filename_key_long(spark, d):
    path = F.col("imageID")
    keyed = view(spark, d, "result_paths").select(path, labels.study_label(path, "CA").alias("study"))
    return keyed.withColumn("trim", labels.filename_key(path, F.col("study"), "result"))


@query
def directory_code(spark, d):
    return ranking.dense_codes(view(spark, d, "metadata"), ["SourceCSV"], "Directory", "unique_chk")


@query
def burst_key(spark, d):
    keyed = assembly.add_burst_key(view(spark, d, "metadata"))
    return keyed.select("SourceCSV", "FileName", "Directory", "unique_chk", "chk_burst", "camID", "cam_chk_burst")


# --- joins and sets --------------------------------------------------------------------


def _predictions(spark, d) -> DataFrame:
    return assembly.label_predictions(view(spark, d, "predictions"))


@query
def left_join_metadata(spark, d):
    left = _predictions(spark, d).select("ROW_NUM", "FileName", "study", "CONFIDENCE1")
    return joins.left_join(left, view(spark, d, "metadata"), ["FileName"])


@query
def natural_left_join(spark, d):
    left = view(spark, d, "images").select("camID", "FileName", "line")
    return joins.natural_left_join(left, _deployments(spark, d), right_unique=True)


@query
def renamed_key_join(spark, d):
    categories = reports.class_names(_categories(spark)).withColumnRenamed("Class_ID", "answer")
    return joins.left_join(view(spark, d, "label_paths"), categories, ["answer"], right_unique=True)


@query
def unmatched_rows(spark, d):
    left = _predictions(spark, d).select("ROW_NUM", "FileName", "study", "CONFIDENCE1")
    return joins.without_match(left, view(spark, d, "metadata"), ["FileName"])


def _listing(spark, d) -> DataFrame:
    """Files of the image store as paths site/date/name; some names are there more than once."""
    images = view(spark, d, "images")
    return images.select(
        F.concat_ws(
            "/", "camID", F.date_format("DateTimeOriginal", "MM_dd_yyyy"), F.element_at(F.split("FileName", "_"), 2)
        ).alias("path")
    )


def _wanted(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".jpg")).alias("name"))


@query
def first_match_lookup(spark, d):
    listing = _listing(spark, d).withColumn("name", text.basename(F.col("path")))
    return joins.first_match(_wanted(spark, d), listing, "name", "path")


@query
def file_manifest(spark, d):
    return exchange.file_manifest(_wanted(spark, d), _listing(spark, d), 3)


@query
def site_override(spark, d):
    dates = view(spark, d, "set_dates").select(
        text.strip_spaces(F.col("camID")).alias("camID"), clock.parse_set_date(F.col("SetDate")).alias("SetDate")
    )
    return joins.override(dates, "camID", "SetDate", {OVERRIDDEN: OVERRIDE_DATE})


@query
def species_crosswalk(spark, d):
    named = exchange.add_database_names(
        view(spark, d, "label_paths").withColumnRenamed("answer", "GUESS1")
    )
    return named.groupBy("GUESS1", "ml_name", "db_name").agg(F.count("*").alias("n"))


@query
def append_studies(spark, d):
    columns = ["FileName", "DateTimeOriginal"]
    ca = view(spark, d, "metadata").select(*columns).withColumn("study", F.lit("tejon"))
    fl = view(spark, d, "day_photos").select(*reversed(columns)).withColumn("study", F.lit("florida"))
    return assembly.append(ca, fl)


@query
def missing_sites(spark, d):
    images = view(spark, d, "images")
    with_pig = images.where((F.col("GUESS1") == PIG) & (F.col("CONFIDENCE1") > 0.99) & (F.year("DateTimeOriginal") == 1997))
    return joins.without_match(images.select("camID").distinct(), with_pig, ["camID"])


@query
def distinct_cameras(spark, d):
    return view(spark, d, "images").select("camID", "study").distinct()


# --- aggregates and windows ------------------------------------------------------------


@query
def frequency_table(spark, d):
    return aggregates.frequency(view(spark, d, "metadata"), "FileName")


@query
def study_counts(spark, d):
    return view(spark, d, "images").groupBy("study", "GUESS1").agg(F.count("*").alias("n"))


@query
def camera_year_crosstab(spark, d):
    wide = reports.camera_year_coverage(view(spark, d, "images"))
    return wide.select("camID", *[F.col(c).alias(f"n_{c}") for c in wide.columns if c != "camID"])


@query
def camera_ranges(spark, d):
    return occ.camera_ranges(view(spark, d, "images"))


@query
def null_profile(spark, d):
    return aggregates.missing_counts(view(spark, d, "metadata"))


@query
def distinct_with_null(spark, d):
    images = view(spark, d, "images")
    return images.groupBy("GUESS1").agg(aggregates.distinct_count("cam_chk_burst").alias("bursts"))


@query
def duplicate_count(spark, d):
    return view(spark, d, "images").agg(
        aggregates.duplicate_count("FileName").alias("duplicates"), F.count("*").alias("n")
    )


_SIX = ("min", "q1", "median", "mean", "q3", "max")


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select(*[F.round(c, 6).alias(c) for c in _SIX], "n")


@query
def six_number_summary(spark, d):
    images = view(spark, d, "images")
    every = _rounded(ranking.six_numbers(images, "CONFIDENCE1")).withColumn("of", F.lit("all"))
    pigs = images.where(F.col("GUESS1") == PIG)
    bursts = assembly.burst_extremes(pigs)
    return every.unionByName(
        _rounded(ranking.six_numbers(bursts, "b_max")).withColumn("of", F.lit("burst"))
    )


@query
def time_summary(spark, d):
    micros = view(spark, d, "images").select(clock.epoch_micros(F.col("DateTimeOriginal")).alias("t"))
    # micros are below 2^53, so a double holds them exactly
    stats = ranking.six_numbers(micros, "t")
    return stats.select(*[F.floor(F.col(c) / 1_000_000).cast("long").alias(c) for c in _SIX if c != "mean"], "n")


@query
def length_summary(spark, d):
    return _rounded(ranking.six_numbers(table(spark, d, "documents").select(F.char_length("text").alias("t")), "t"))


@query
def histogram(spark, d):
    """Bins that start above the lowest value and end above the highest."""
    return aggregates.histogram(view(spark, d, "images"), "CONFIDENCE1", 0.125, 0.125, 10)


@query
def burst_extremes(spark, d):
    return assembly.burst_extremes(view(spark, d, "images").where(F.col("GUESS1") == PIG))


@query
def burst_extremes_on_images(spark, d):
    images = view(spark, d, "images").where(F.col("GUESS1") == PIG)
    return assembly.with_burst_extremes(images).select("FileName", "line", "cam_chk_burst", "b_max", "b_min")


@query
def tally_rank(spark, d):
    return reports.species_tally(view(spark, d, "label_paths"), _categories(spark))


@query
def dedup_first(spark, d):
    images = view(spark, d, "images").select("FileName", "DateTimeOriginal", "line", "part")
    return assembly.deduplicate(images, ["DateTimeOriginal", "line", "part"])


@query
def sorted_bursts(spark, d):
    images = view(spark, d, "images").select("camID", "cam_chk_burst", "line", "FileName")
    keys = [F.asc_nulls_last(c) for c in ("camID", "cam_chk_burst", "line")]
    return ranking.sort_spread(images, *keys)


@query
def row_slice(spark, d):
    return ranking.row_slice(_deployments(spark, d), ["camID"], 30, 43)


@query
def first_rows(spark, d):
    images = view(spark, d, "images").select("FileName", "line", "part", "CONFIDENCE1")
    return images.orderBy(F.desc("CONFIDENCE1"), "FileName", "line", "part").limit(6)


# --- occupancy -------------------------------------------------------------------------


def _categories(spark) -> DataFrame:
    return exchange.crosswalk(spark).select(F.col("ml_code").alias("Class_ID"), F.col("ml_name").alias("className"))


def _deployments(spark, d) -> DataFrame:
    return site_override(spark, d)


def _full(spark, d, time_int: str, thresh: float = 0.5, mask: bool = True) -> DataFrame:
    return occ.occupancy(view(spark, d, "images"), _deployments(spark, d), PIG, thresh, time_int, mask)


@query
def occ_week(spark, d):
    return occ.detection_grid(view(spark, d, "images"), PIG, 0.5, "week")


@query
def occ_day(spark, d):
    return occ.detection_grid(view(spark, d, "images"), PIG, 0.5, "day")


@query
def occ_month(spark, d):
    return occ.detection_grid(view(spark, d, "images"), PIG, 0.5, "month")


@query
def occ_week_missing_null(spark, d):
    return occ.detection_grid(view(spark, d, "images"), PIG, 0.98, "week", missing_site=None)


@query
def occ_zero_week(spark, d):
    return _full(spark, d, "week", mask=False)


@query
def occ_zero_day(spark, d):
    return _full(spark, d, "day", mask=False)


@query
def occ_masked_week(spark, d):
    return _full(spark, d, "week")


@query
def occ_masked_day(spark, d):
    return _full(spark, d, "day")


@query
def occ_steps_week(spark, d):
    """The three steps one after the other on long tables."""
    images, deployments = view(spark, d, "images"), _deployments(spark, d)
    grid = occ.detection_grid(images, PIG, 0.5, "week")
    return occ.mask_inactive(occ.zero_complete(grid, deployments, images, "week"), images, "week")


@query
def occ_mask_only_day(spark, d):
    images = view(spark, d, "images")
    return occ.mask_inactive(occ.detection_grid(images, PIG, 0.9, "day"), images, "day")


@query
def occ_year_masked_day(spark, d):
    images = occ.year_images(view(spark, d, "images"), 1996)
    return occ.mask_inactive(occ.detection_grid(images, PIG, 0.0, "day"), images, "day")


@query
def occ_year_full_day(spark, d):
    """All three steps on the photos of one year."""
    images = occ.year_images(view(spark, d, "images"), 1996)
    return occ.occupancy(images, _deployments(spark, d), PIG, 0.0, "day")


@query
def occ_by_year_null(spark, d):
    return occ.yearly_detections(view(spark, d, "images"), PIG)


def _event_images(spark, d) -> DataFrame:
    """Events as a month of photos: users are cameras, event types species."""
    return table(spark, d, "events").select(
        F.concat(F.lit("EV-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("camID"),
        F.when(F.col("event_type") == "error", PIG).otherwise(1).alias("GUESS1"),
        (F.col("value") / 500).alias("CONFIDENCE1"),
        F.col("ts").alias("DateTimeOriginal"),
    )


def _event_deployments(images: DataFrame) -> DataFrame:
    return images.groupBy("camID").agg(F.to_date(F.min("DateTimeOriginal")).alias("SetDate"))


@query
def occ_hour(spark, d):
    images = _event_images(spark, d)
    return occ.occupancy(images, _event_deployments(images), PIG, 0.01, "hour")


@query
def occ_events_day(spark, d):
    images = _event_images(spark, d)
    return occ.occupancy(images, _event_deployments(images), PIG, 0.01, "day")


@query
def occ_wide_month(spark, d):
    return reshape.widen(occ_month(spark, d), "month")


@query
def occ_wide_hour(spark, d):
    """The hourly table written as a wide file, one field per hour, and read back."""
    folder = new_folder(spark, "wide-hour")
    writers.write_wide(occ_hour(spark, d), folder, "hour")
    return readers.read_wide(spark, folder)


def _store(spark, d) -> cellstore.CellStore:
    """The images of both studies as two checks; the first one is added with a mistake and then replaced."""
    store, images = cellstore.CellStore(new_folder(spark, "cells")), view(spark, d, "images")
    fl = images.where(F.col("study") == "FL")
    store.add(fl.withColumn("CONFIDENCE1", 1 - F.col("CONFIDENCE1")), "FL")
    store.add(fl, "FL")
    store.add(images.where(F.col("study") != "FL"), "CA")
    return store


@query
def occ_store_tables(spark, d):
    """Week, day and month tables of three species from stored cells, each image read once per check."""
    return _store(spark, d).tables(spark, _deployments(spark, d), (PIG, 1, 15), 0.5, ("week", "day", "month"))


@query
def occ_store_sweeps(spark, d):
    """Both sweeps from the same stored cells."""
    store, sites = _store(spark, d), _deployments(spark, d)
    parts = [store.occupancy_sweep(spark, sites, PIG, g, 0.5, 0.51, n=49).withColumn("time_int", F.lit(g)) for g in ("week", "day")]
    return parts[0].union(parts[1])


@query
def occ_store_year(spark, d):
    """All three steps on the cells of one year, which are a partition."""
    return _store(spark, d).occupancy(spark, _deployments(spark, d), PIG, 0.0, "day", year=1996)


@query
def occ_store_hour(spark, d):
    store, images = cellstore.CellStore(new_folder(spark, "cells"), "hour"), _event_images(spark, d)
    store.add(images, "events")
    return store.occupancy(spark, _event_deployments(images), PIG, 0.01, "hour")


@query
def occ_unpivot(spark, d):
    return reshape.lengthen(reshape.widen(_full(spark, d, "week"), "week"))


@query
def occ_total(spark, d):
    return _full(spark, d, "week").groupBy("year").agg(
        F.sum("occ").alias("occ"), F.count_if(F.col("occ").isNull()).alias("blank")
    )


# --- sweeps ----------------------------------------------------------------------------


@query
def image_retention(spark, d):
    return sweeps.image_retention(view(spark, d, "images"))


@query
def image_retention_absent(spark, d):
    """Codes that no image has still get every threshold."""
    return sweeps.image_retention(view(spark, d, "images"), {"none": 99, "cattle": 1, "never": -1})


@query
def burst_retention(spark, d):
    return sweeps.burst_retention(view(spark, d, "images"))


@query
def burst_retention_absent(spark, d):
    return sweeps.burst_retention(view(spark, d, "images"), species=99)


@query
def burst_filtered_images(spark, d):
    pigs = view(spark, d, "images").where(F.col("GUESS1") == PIG)
    return assembly.burst_filtered(pigs, 0.4999).select("FileName", "line", "CONFIDENCE1", "b_max", "b_min")


def _sweep(spark, d, time_int, baseline, start, n, deployments=True):
    sites = _deployments(spark, d) if deployments else None
    return sweeps.occupancy_sweep(view(spark, d, "images"), sites, PIG, time_int, baseline, start, n=n)


@query
def occ_sweep_week_b50(spark, d):
    return _sweep(spark, d, "week", 0.5, 0.51, 49)


@query
def occ_sweep_week_b0(spark, d):
    return _sweep(spark, d, "week", 0.0, 0.01, 99)


@query
def occ_sweep_day_b50(spark, d):
    return _sweep(spark, d, "day", 0.5, 0.51, 49)


@query
def occ_sweep_week_no_zeros(spark, d):
    return _sweep(spark, d, "week", 0.5, 0.51, 49, deployments=False)


@query
def occ_sweep_day_no_zeros(spark, d):
    return _sweep(spark, d, "day", 0.5, 0.51, 49, deployments=False)


@query
def occ_sweep_hour(spark, d):
    images = _event_images(spark, d)
    return sweeps.occupancy_sweep(images, _event_deployments(images), PIG, "hour", 0.0, 0.01, n=99)


@query
def occ_sweep_absent(spark, d):
    return sweeps.occupancy_sweep(view(spark, d, "images"), _deployments(spark, d), 99, "week", 0.5, 0.51)


# --- whole jobs ------------------------------------------------------------------------


@query
def image_table(spark, d):
    joined = assembly.image_table(_predictions(spark, d), view(spark, d, "metadata"))
    return joined.select(
        "ROW_NUM", "study", "FileName", "Directory", "camID", "GUESS1", "CONFIDENCE1", "DateTimeOriginal",
        "DateTimeUTC", "year", "week", "day", "hour", "month",
    )


@query
def image_table_complete(spark, d):
    metadata = assembly.deduplicate(assembly.add_burst_key(view(spark, d, "metadata")), ["SourceCSV", "Directory"])
    metadata = metadata.drop("camID")
    joined = assembly.image_table(_predictions(spark, d), metadata, complete_only=True, metadata_unique=True)
    return joined.select("ROW_NUM", "study", "FileName", "cam_chk_burst", "CONFIDENCE1", "DateTimeOriginal", "yday")


@query
def deployment_table(spark, d):
    dates = view(spark, d, "set_dates")
    return exchange.deployment_table(view(spark, d, "images"), dates, {OVERRIDDEN: OVERRIDE_DATE})


def _photo_db(spark, d) -> DataFrame:
    order = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    return table(spark, d, "orders").select(
        F.concat(F.lit("CA-01_06_01_2015_CA_"), order, F.lit(".jpg")).alias("filename"),
        F.col("o_custkey").cast("string").alias("UnkID"),
        F.when(F.col("o_orderkey") % 40 > 0, F.col("o_orderstatus")).alias("speciesID"),
    )


@query
def photo_db_merge(spark, d):
    dated = _predictions(spark, d).select(
        F.col("ROW_NUM").alias("X1"), F.col("FileName").alias("filename"), F.col("study").alias("Directory"),
        "GUESS1", "CONFIDENCE1",
    )
    return exchange.merge_photo_db(_photo_db(spark, d), dated)


def _photo_name():
    return F.concat_ws("_", "FileName", "line", "part")


def _clean_output(spark, d) -> DataFrame:
    """Classifier output of every image; those of line 7 have lost their name."""
    name = F.when(F.col("line") < 7, _photo_name()).otherwise("unnamed")
    return view(spark, d, "images").select(
        F.col("camID").alias("camera"),
        F.col("part").cast("int").alias("X1"),
        F.concat(F.lit("/cams/Resized/"), name, F.lit('"')).alias("fileName"),
        F.col("GUESS1").alias("answer"),
        F.col("GUESS1").alias("guess1"),
        F.col("CONFIDENCE1").alias("confidence1"),
    )


@query
def import_conversion(spark, d):
    ids = view(spark, d, "images").select(
        F.col("camID").alias("camera"), F.concat_ws("-", "part", "line").alias("ImageID"), _photo_name().alias("FileName")
    )
    return exchange.to_import(_clean_output(spark, d), ids)


@query
def quality_report(spark, d):
    predictions, metadata = _predictions(spark, d), view(spark, d, "metadata")
    joined = joins.left_join(predictions.select("FileName"), metadata.select("FileName", "DateTimeOriginal", F.lit(True).alias("found")), ["FileName"])
    joined = joined.withColumn("photo_time", clock.parse_photo_time(F.col("DateTimeOriginal")))
    return reports.quality_report(predictions, metadata, joined)


@query
def day_night(spark, d):
    return daynight.label_day_night_by_study(view(spark, d, "day_photos")).select("FileName", "study", "daynight")


@query
def sun_limits(spark, d):
    """Sun times of every order date at the two study places, to the second."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    out = None
    from trapgrid.functions.sun import sun_times

    for study in ("CA", "FL"):
        lat, lon, _ = assembly.SITES[study]
        rise, sink = sun_times(F.col("date"), F.lit(lat), F.lit(lon))
        part = days.select(
            "date",
            F.lit(study).alias("study"),
            F.floor(rise / 1_000_000).cast("long").alias("sunrise_end"),
            F.floor(sink / 1_000_000).cast("long").alias("sunset_start"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def day_night_results(spark, d):
    photos = view(spark, d, "day_photos")
    ca = daynight.label_day_night(photos.where(F.col("study") == "CA"), 34.9, -118.7, "US/Pacific")
    fl = daynight.label_day_night(photos.where(F.col("study") == "FL"), 27.1, -81.1, "US/Eastern")
    cpw = photos.where(F.col("study") == "CPW").withColumn("daynight", F.lit("day"))
    joined = daynight.day_night_results(view(spark, d, "result_paths"), ca, fl, cpw)
    return joined.select("imageID", "answer", "study", "trim", "DateTimeOriginal", "daynight")


# --- files -----------------------------------------------------------------------------


@query
def csv_round_trip(spark, d):
    folder = new_folder(spark, "metadata")
    writers.write_table(view(spark, d, "metadata"), folder)
    return readers.read_table(spark, folder, schemas.BURST_METADATA)


def _awkward(spark, d) -> DataFrame:
    """Metadata with NA, quotes, commas and nothing in their texts."""
    order = F.col("o_orderkey")
    remark = F.when(order % 4 == 0, 'say "hi", a.jpg').when(order % 4 == 1, "NA").when(order % 4 == 2, "").otherwise('"')
    return table(spark, d, "orders").select(
        F.concat_ws("/", F.lit("E:, x"), "o_orderpriority").alias("Directory"),
        F.concat(F.lit("CA_"), order.cast("string"), F.lit(".jpg")).alias("FileName"),
        remark.alias("DateTimeOriginal"),
        F.when(order % 3 > 0, order.cast("string")).otherwise("NA").alias("Sequence"),
        (order % 1000).cast("string").alias("EventNumber"),
        F.lit("more").alias("Other"),
        (order % 2).alias("file"),
    )


@query
def csv_as_written(spark, d):
    """Files of one folder whose columns stand in two orders."""
    folder, rows = new_folder(spark, "field"), _awkward(spark, d)
    names = [c for c in rows.columns if c != "file"]
    for file, order in ((0, names), (1, sorted(names, reverse=True))):
        part = rows.where(F.col("file") == file).select(*order)
        part.write.options(header=True, quote='"', escape='"', emptyValue="").csv(f"{folder}/check{file}")
    found = readers.read_metadata_folder(spark, folder)
    return found.withColumn("SourceCSV", F.regexp_extract("SourceCSV", "(check[01])/", 1))


@query
def csv_line_breaks(spark, d):
    """Texts with line breaks, quotes and outer blanks, written and read again."""
    folder = new_folder(spark, "remarks")
    key = F.col("o_orderkey")
    remark = F.when(key % 4 == 0, F.concat(F.lit("two\nlines, "), "o_orderpriority")).when(key % 4 == 1, F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")))
    remark = remark.when(key % 4 == 2, F.concat(F.lit('"\n"'), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    writers.write_table(table(spark, d, "orders").select(key.alias("photo"), remark.alias("remark")), folder)
    return readers.read_table(spark, folder, "remark string, photo long")


def _in_order(spark, d, name: str, *columns) -> DataFrame:
    """Columns of the orders as files whose lines are in the order of the keys, read with their places."""
    folder, keyed = new_folder(spark, name), table(spark, d, "orders").select("o_orderkey", *columns)
    lines = keyed.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey").select(*keyed.columns[1:])
    writers.write_table(lines, folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return readers.read_table(spark, folder, schema, position=f"{name}_at")


@query
def first_by_file(spark, d):
    """The first line of each camera, in the order of the files."""
    lines = _in_order(spark, d, "lines", F.col("o_custkey").alias("cam"), F.col("o_orderkey").alias("photo"))
    return joins.first_per_key(lines, ["cam"], ["lines_at"]).select("cam", "photo")


@query
def bound_by_line(spark, d):
    """Two files side by side, line by line, though neither has a key."""
    left = _in_order(spark, d, "left", F.col("o_orderkey").alias("photo"))
    right = _in_order(spark, d, "right", F.col("o_orderpriority").alias("place"))
    return ranking.bind_by_line(left, right, "left_at", "right_at").select("photo", "place")


@query
def unreadable_counts(spark, d):
    """How many texts of each column are no value of its type, counted in the pass that writes the rows."""
    field, out, key = new_folder(spark, "field"), new_folder(spark, "clean"), F.col("o_orderkey")
    event = F.when(key % 5 == 0, "n/a").when(key % 7 == 0, "NA").otherwise(key.cast("string")).alias("event")
    score = F.when(key % 11 == 0, "0,5").otherwise((key / 8).cast("string")).alias("score")
    writers.write_table(table(spark, d, "orders").select(event, score, F.col("o_orderpriority").alias("place")), field)
    watch = Observation("unreadable")
    writers.write_table(readers.read_table(spark, field, "event long, score double, place string", watch=watch), out)
    return spark.createDataFrame(sorted(watch.get.items()), "column string, unreadable long")


@query
def named_import_files(spark, d):
    """One named file for each camera, written and read back with the camera of its folder."""
    folder = new_folder(spark, "import")
    images = view(spark, d, "images").groupBy(F.col("camID").alias("camera"), "GUESS1").agg(F.count("*").alias("n"))
    writers.write_named(images, folder, 2)
    return readers.read_camera_folders(spark, folder, "*_check2_to_import.csv", "GUESS1 int, n long").drop("check_num")


@query
def walked_manifest(spark, d):
    """A tree of import files, one folder per camera, listed by tasks and matched with the files wanted of all suppliers."""
    folder = new_folder(spark, "tree")
    images = view(spark, d, "images").where(F.col("study") == "FL").groupBy(F.col("camID").alias("camera")).agg(F.count("*").alias("n"))
    writers.write_named(images, folder, 2)
    name = F.concat(F.lit("CAM-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("_check2_to_import.csv"))
    return exchange.file_manifest(table(spark, d, "supplier").select(name.alias("name")), listing.walk_files(spark, folder), 2)


@query
def double_key_join(spark, d):
    """Keys that are numbers with a fraction; zero is one key, whatever its sign, and holds most rows."""
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 5, 0.0).otherwise(F.col("l_suppkey") / 4).alias("key"))
    supplier = F.col("s_suppkey")
    right = table(spark, d, "supplier").select(F.when(supplier == 1, F.lit(-0.0)).otherwise(supplier / 4).alias("key"), supplier.alias("supplier"))
    return joins.left_join(left, right, ["key"]).select("l_orderkey", "l_linenumber", "supplier")


@query
def exported_metadata(spark, d):
    folder = new_folder(spark, "exported")
    rows = view(spark, d, "day_photos").withColumn("FileSize", F.lit(9))
    writers.write_table(rows.select("FileSize", "FileName", "study", "SourceFile", "DateTimeOriginal"), folder)
    return readers.read_exported_metadata(spark, folder)


@query
def listing_scan(spark, d):
    folder = new_folder(spark, "listing")
    writers.write_listing(_listing(spark, d).withColumn("length", F.char_length("path").cast("long")), folder)
    return readers.read_listing(spark, folder).groupBy("path", "length").agg(F.count("*").alias("n"))


@query
def headerless_scan(spark, d):
    folder = new_folder(spark, "labels")
    view(spark, d, "label_paths").write.options(quote='"', escape='"').csv(folder)
    return readers.read_headerless(spark, folder, schemas.LABEL_LIST)


@query
def indexed_export(spark, d):
    folder = new_folder(spark, "indexed")
    writers.write_indexed(_deployments(spark, d), folder, ["camID"])
    return readers.read_table(spark, folder, "X1 long, camID string, SetDate date")


@query
def metadata_folder_scan(spark, d):
    """Metadata written as one folder per check and read back with the file each row came from."""
    folder = new_folder(spark, "checks")
    metadata = view(spark, d, "metadata").hint("rebalance", "SourceCSV")
    metadata.write.options(header=True, quote='"', escape='"').partitionBy("SourceCSV").csv(folder)
    rows = readers.read_metadata_folder(spark, folder)
    source = F.regexp_extract("SourceCSV", "SourceCSV=([^/]+)/", 1)
    return ranking.dense_codes(rows.withColumn("SourceCSV", source), ["SourceCSV"], "Directory", "unique_chk")


@query
def partitioned_export(spark, d):
    """Import tables written per camera and check, read back with both from the path."""
    folder = new_folder(spark, "imports")
    images = view(spark, d, "images").select(
        F.col("camID").alias("camera"), F.concat_ws("-", "part", "line").alias("ImageID"), "FileName"
    )
    writers.write_per_camera(images, folder, 2)
    rows = readers.read_camera_folders(spark, folder, "*.csv", schemas.IMPORT_TABLE)
    return rows.groupBy("camera", "check_num").agg(F.count("*").alias("n"), F.count_distinct("ImageID").alias("images"))


@query
def image_table_parquet(spark, d):
    """The image table written by study and year and read back."""
    folder = new_folder(spark, "images")
    images = view(spark, d, "images").withColumn("year", F.year("DateTimeOriginal"))
    writers.write_image_table(images, folder)
    stored = spark.read.parquet(folder)
    return stored.select("study", "year", "FileName", "line", "CONFIDENCE1")
