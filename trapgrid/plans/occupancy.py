"""Camera × interval occupancy tables in long form: (camID, year, interval, occ).

occ is 1 (species seen), 0 (not seen) or null (camera not active). Images are reduced to one
row per camera and interval before anything else, and then to one row per camera with an
array of its detection intervals; a calendar bounds that array. The interval columns of the
whole table and the limits of the study period are likewise one small row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.functions.clock import GRAINS, Grain, elapsed, grain
from trapgrid.session import shuffle_partitions

DETECTION_GRAINS = ("day", "week", "month", "hour")
MASK_GRAINS = ("day", "week", "hour")
_YEAR = 10_000


def _need_time(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        raise ValueError(f"{column} must be a timestamp or date, not {df.schema[column].dataType.simpleString()}")


def _score() -> Column:
    return F.coalesce(F.when(~F.isnan("CONFIDENCE1"), F.col("CONFIDENCE1")), F.lit(float("-inf")))


def cells(images: DataFrame, species: int, g: Grain, time: str = "DateTimeOriginal") -> DataFrame:
    """One row per camera and interval: best confidence of the species, first and last photo."""
    return (
        images.where(F.col("camID").isNotNull() & F.col(time).isNotNull())
        .groupBy("camID", g.code(F.col(time)).alias("code"))
        .agg(
            F.max(F.when(F.col("GUESS1") == species, _score())).alias("best"),
            F.min(time).alias("first_photo"),
            F.max(time).alias("last_photo"),
        )
    )


def seen(thresh: float | None) -> Column:
    """Whether a cell's best confidence counts as a detection."""
    return F.col("best").isNotNull() if thresh is None else F.col("best") > F.lit(float(thresh))


def _hits(images: DataFrame, species: int, thresh: float | None, g: Grain, time: str) -> DataFrame:
    """One row per camera, year and interval with a detection (null: all other photos of the year), with first and last photo.

    Photos without a detection are only a camera's years, so that no task holds a group for each of their intervals.
    """
    best = F.when(F.col("GUESS1") == species, _score())
    found = best.isNotNull() if thresh is None else best > F.lit(float(thresh))
    return (
        images.where(F.col("camID").isNotNull() & F.col(time).isNotNull())
        .groupBy("camID", F.year(time).alias("year"), F.when(found, g.code(F.col(time))).alias("hit"))
        .agg(F.min(time).alias("first_photo"), F.max(time).alias("last_photo"))
    )


def _hits_of(base: DataFrame, thresh: float | None) -> DataFrame:
    """_hits from the cells of a species and a grain."""
    hit = F.when(seen(thresh), F.col("code")).alias("hit")
    return base.select("camID", _whole_div(F.col("code")).alias("year"), hit, "first_photo", "last_photo")


def spread(sites: DataFrame) -> DataFrame:
    """Rows per camera over all shuffle partitions: a few bytes of each become thousands of cells, which sizes do not show."""
    return sites.repartition(shuffle_partitions(sites.sparkSession), "camID")


def _whole_div(code: Column) -> Column:
    return F.floor(code / _YEAR).cast("int")


def _as_rows(sites: DataFrame, lists: list[tuple[int | None, Column]], value: Column | None = None) -> DataFrame:
    """The long form of lists of interval codes, each with its value of `occ`; `value` is made of _occ, _code and the site's columns."""
    named = F.array(*[F.struct(F.lit(occ).cast("int").alias("_occ"), codes.alias("_codes")) for occ, codes in lists])
    long = sites.select("*", F.inline(named)).select("*", F.explode("_codes").alias("_code"))
    return long.select(
        "camID",
        _whole_div(F.col("_code")).alias("year"),
        (F.col("_code") % _YEAR).cast("int").alias("interval"),
        (F.col("_occ") if value is None else value).cast("int").alias("occ"),
    )


def _fill(codes: Column, hits: Column) -> list[tuple[int | None, Column]]:
    """Every code of the table: 1 where the camera has a hit, else 0."""
    return [(1, F.array_intersect(codes, hits)), (0, F.array_except(codes, hits))]


def regular_codes(years: Column, first_set: Column, last_photo: Column, g: Grain) -> Column:
    """Interval codes from the earliest set date to the last photo, for the years with photos."""

    def of_year(y: Column) -> Column:
        start = F.when(y == F.year(first_set), g.interval(first_set)).otherwise(g.first).cast("int")
        end = F.when(y == F.year(last_photo), g.interval(last_photo)).otherwise(g.last).cast("int")
        full = F.transform(F.sequence(start, F.greatest(start, end)), lambda i: (y * _YEAR + i).cast("int"))
        return F.when(start <= end, full).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(years, of_year))


def start_cut(first: Column, global_first: Column, codes: Column, g: Grain, instant: tuple[Column, Column]) -> Column:
    """Last interval code to blank at a camera's start, or null.

    A camera that starts in another year than the first column is blank up to and including
    its start interval, otherwise the first 1 + round(late) columns are.
    """
    late = elapsed(*instant, g.name)
    by_position = F.get(codes, F.least(F.rint(late).cast("int"), F.size(codes) - 1))
    by_label = F.year(first) != _whole_div(F.get(codes, F.lit(0)))
    return F.when(F.abs(late) > 1, F.when(by_label, g.code(first)).otherwise(by_position))


def end_cut(last: Column, g: Grain, instant: tuple[Column, Column]) -> Column:
    """First interval code to blank at a camera's end, or null."""
    return F.when(F.abs(elapsed(*instant, g.name)) > 1, g.code(last))


def _unmasked(code: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (code > start)) & (end.isNull() | (code < end))


def _one_row(df: DataFrame) -> Column:
    """A one-row frame as a value, so that no join is needed to use it."""
    return df.select(F.struct(*df.columns)).scalar()


def detection_grid(
    images: DataFrame,
    species: int,
    thresh: float | None,
    time_int: str,
    missing_site: int | None = 0,
    time: str = "DateTimeOriginal",
) -> DataFrame:
    """Every camera × every interval in which any camera saw the species above `thresh`.

    `missing_site` is the value of a camera without a detection in the whole year: 0 or None.
    """
    return _grid(_hits(images, species, thresh, grain(time_int, DETECTION_GRAINS), time), missing_site)


def grid_of(base: DataFrame, thresh: float | None, missing_site: int | None = 0) -> DataFrame:
    """detection_grid from the cells of a species and a grain."""
    return _grid(_hits_of(base, thresh), missing_site)


def _grid(base: DataFrame, missing_site: int | None) -> DataFrame:
    # A camera's hits differ; a set would let Spark drop the aggregate below it and take all photos to the cameras.
    sites = base.groupBy("camID").agg(F.collect_list("hit").alias("hits"))
    codes = sites.select(F.explode("hits").alias("hit")).distinct().agg(F.collect_set("hit")).scalar()
    return grid_rows(sites, codes, missing_site)


def grid_rows(sites: DataFrame, codes: Column, missing_site: int | None = 0) -> DataFrame:
    """detection_grid from each camera's `hits` and the codes of the table."""
    rows = spread(sites.select("camID", "hits")).withColumn("codes", codes)
    rows = rows.withColumn("years", F.array_distinct(F.transform("hits", _whole_div)))
    with_detection = F.array_contains("years", _whole_div(F.col("_code")))
    zero = F.when(with_detection, 0).otherwise(F.lit(missing_site).cast("int"))
    return _as_rows(rows, _fill(F.col("codes"), F.col("hits")), F.when(F.col("_occ") == 1, 1).otherwise(zero))


def _sites_of(occ: DataFrame) -> DataFrame:
    code = (F.col("year") * _YEAR + F.col("interval")).cast("int")
    return occ.groupBy("camID").agg(
        F.collect_set(F.when(F.col("occ") == 1, code)).alias("hits"),
        F.collect_set(F.when(F.col("occ").isNull(), code)).alias("blanks"),
    )


def _codes_of(occ: DataFrame) -> Column:
    """All interval codes of a long table in order, as a value."""
    code = (F.col("year") * _YEAR + F.col("interval")).cast("int").alias("code")
    return occ.select(code).distinct().agg(F.array_sort(F.collect_set("code"))).scalar()


def zero_complete(
    occ: DataFrame, deployments: DataFrame, images: DataFrame, time_int: str, time: str = "DateTimeOriginal"
) -> DataFrame:
    """The table widened to all intervals of the study period, rows = cameras of `deployments`.

    The period runs from the earliest SetDate to the last photo, over the years with photos.
    New cells are 0; intervals that the table already has stay, also outside the period.
    """
    g = grain(time_int, MASK_GRAINS)
    _need_time(images, time)
    _need_time(deployments, "SetDate")
    period = images.agg(
        F.sort_array(F.collect_set(F.year(time))).alias("years"), F.max(time).alias("last_photo")
    ).withColumns(
        {
            "first_set": deployments.agg(F.min("SetDate")).scalar(),
            "present": _codes_of(occ),
        }
    )
    regular = regular_codes(F.col("years"), F.col("first_set"), F.col("last_photo"), g)
    present = F.filter("present", lambda c: F.array_contains(F.col("years"), _whole_div(c)))
    codes = period.select(F.array_sort(F.array_union(regular, present)).alias("codes")).scalar()
    empty = F.array().cast("array<int>")
    rows = spread(deployments.select("camID").distinct().join(_sites_of(occ), "camID", "left")).withColumn("codes", codes)
    rows = rows.withColumns({c: F.coalesce(F.col(c), empty) for c in ("hits", "blanks")})
    filled = _fill(F.array_except("codes", "blanks"), F.col("hits"))
    return _as_rows(rows, [*filled, (None, F.array_intersect("codes", "blanks"))])


def camera_ranges(images: DataFrame, time: str = "DateTimeOriginal") -> DataFrame:
    """First and last photo of each camera and their years."""
    spans = images.groupBy("camID").agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"))
    return spans.select(
        "camID",
        "start_date",
        F.year("start_date").alias("start_yr"),
        "end_date",
        F.year("end_date").alias("end_yr"),
    )


def mask_inactive(
    occ: DataFrame, images: DataFrame, time_int: str, time: str = "DateTimeOriginal", instant: str | None = None
) -> DataFrame:
    """The table with the intervals before a camera's first and after its last photo blanked.

    `instant` names a UTC column of the photos to measure distances on; calendar parts always
    come from `time`.
    """
    g = grain(time_int, MASK_GRAINS)
    _need_time(images, time)
    at = instant or time
    code = (F.col("year") * _YEAR + F.col("interval")).cast("int")
    ranges = images.groupBy("camID").agg(
        F.min(time).alias("s"), F.max(time).alias("e"), F.min(at).alias("si"), F.max(at).alias("ei")
    )
    # All four, so that both uses of the ranges share one shuffle.
    study = _one_row(ranges.agg(*[f(c).alias(c) for c, f in (("s", F.min), ("e", F.max), ("si", F.min), ("ei", F.max))]))
    cuts = ranges.withColumns({"study": study, "codes": _codes_of(occ)})
    cuts = cuts.select(
        "camID",
        start_cut(F.col("s"), F.col("study.s"), F.col("codes"), g, (F.col("si"), F.col("study.si"))).alias("start"),
        end_cut(F.col("e"), g, (F.col("ei"), F.col("study.ei"))).alias("end"),
    )
    # One row per camera is hashed, so that the long table passes by it unsorted.
    masked = occ.join(cuts.hint("shuffle_hash"), "camID", "left")
    keep = _unmasked(code, F.col("start"), F.col("end"))
    return masked.select("camID", "year", "interval", F.when(keep, F.col("occ")).alias("occ"))


def occupancy(
    images: DataFrame,
    deployments: DataFrame,
    species: int,
    thresh: float | None,
    time_int: str,
    mask: bool = True,
    time: str = "DateTimeOriginal",
) -> DataFrame:
    """detection_grid, zero_complete and mask_inactive in one pass over the images."""
    _need_time(images, time)
    g = grain(time_int, MASK_GRAINS)
    return _occupancy(_hits(images, species, thresh, g, time), deployments, g, mask)


def occupancy_of(base: DataFrame, deployments: DataFrame, thresh: float | None, time_int: str, mask: bool = True) -> DataFrame:
    """occupancy from the cells of a species and a grain."""
    return _occupancy(_hits_of(base, thresh), deployments, grain(time_int, MASK_GRAINS), mask)


def _occupancy(base: DataFrame, deployments: DataFrame, g: Grain, mask: bool) -> DataFrame:
    _need_time(deployments, "SetDate")
    study = base.agg(
        F.min("first_photo").alias("first"),
        F.max("last_photo").alias("last"),
        F.sort_array(F.collect_set("year")).alias("years"),
        F.collect_set("hit").alias("found"),
    ).withColumn("first_set", deployments.agg(F.min("SetDate")).scalar())
    sites = base.groupBy("camID").agg(
        F.min("first_photo").alias("s"), F.max("last_photo").alias("e"), F.collect_list("hit").alias("hits")
    )
    return occupancy_rows(deployments.select("camID").distinct().join(sites, "camID", "left"), study, g, mask)


def occupancy_rows(sites: DataFrame, study: DataFrame, g: Grain, mask: bool = True) -> DataFrame:
    """occupancy from each camera's first and last photo (`s`, `e`) and `hits`, and the one row of the study's limits."""
    regular = regular_codes(F.col("years"), F.col("first_set"), F.col("last"), g)
    study = study.select("first", "last", F.array_sort(F.array_union(regular, F.col("found"))).alias("codes"))
    rows = spread(sites).withColumn("study", _one_row(study)).withColumn("codes", F.col("study.codes"))
    if mask:
        rows = rows.withColumns(
            {
                "start": start_cut(
                    F.col("s"), F.col("study.first"), F.col("codes"), g, (F.col("s"), F.col("study.first"))
                ),
                "end": end_cut(F.col("e"), g, (F.col("e"), F.col("study.last"))),
            }
        )
    else:
        # Never set: no camera's first photo comes after its last. Both are named so that this aggregate
        # stays the one that the study's limits share, and the images are read once.
        never = F.when(F.col("s") > F.col("e"), F.lit(0))
        rows = rows.withColumns({"start": never, "end": never})
    hits = F.coalesce("hits", F.array().cast("array<int>"))
    active = _unmasked(F.col("_code"), F.col("start"), F.col("end"))
    return _as_rows(rows, _fill(F.col("codes"), hits), F.when(active, F.col("_occ")))


def yearly_detections(images: DataFrame, species: int, time_int: str = "week") -> DataFrame:
    """Occupancy without a threshold; a camera is blank in a year without a detection."""
    return detection_grid(images, species, None, time_int, missing_site=None)


def year_images(images: DataFrame, year: int, time: str = "DateTimeOriginal") -> DataFrame:
    """Photos of one year, as a range so that a partitioned or sorted table is pruned."""
    low, high = (F.lit(date(y, 1, 1)).cast("timestamp_ntz") for y in (year, year + 1))
    return images.where((F.col(time) >= low) & (F.col(time) < high))


__all__ = [
    "GRAINS",
    "camera_ranges",
    "cells",
    "detection_grid",
    "grid_of",
    "mask_inactive",
    "occupancy",
    "occupancy_of",
    "year_images",
    "yearly_detections",
    "zero_complete",
]
