"""Day and night labels from photo time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapgrid.functions.clock import parse_photo_time, to_utc
from trapgrid.functions.labels import filename_key, study_label
from trapgrid.functions.sun import day_or_night
from trapgrid.operators.joins import left_join
from trapgrid.plans.images import append, site_value


def label_day_night(photos: DataFrame, lat: float, lon: float, zone: str) -> DataFrame:
    """Photos with text DateTimeOriginal and a daynight column. No shuffle."""
    wall = parse_photo_time(F.col("DateTimeOriginal"))
    label = day_or_night(to_utc(wall, zone), F.to_date(wall), F.lit(lat), F.lit(lon))
    return photos.withColumn("daynight", label)


def label_day_night_by_study(photos: DataFrame) -> DataFrame:
    """The same for photos of several studies; null where the study has no known place."""
    study = F.col("study")
    wall = parse_photo_time(F.col("DateTimeOriginal"))
    label = day_or_night(
        to_utc(wall, site_value(study, 2)), F.to_date(wall), site_value(study, 0), site_value(study, 1)
    )
    return photos.withColumn("daynight", label)


def day_night_results(results: DataFrame, *labelled: DataFrame) -> DataFrame:
    """Test results with the day/night label of their photo.

    `labelled` tables (FileName, DateTimeOriginal, daynight, ..) are appended and rows with
    anything missing dropped; results get study and key and are left-joined on it. Studies
    without a key rule (no photo metadata) are left out.
    """
    table = append(*labelled).dropna("any").drop("study").withColumnRenamed("FileName", "trim")
    study = study_label(F.col("imageID"), "CA")
    keyed = results.withColumn("study", study).where(F.col("study").isin("SREL", "CPW", "CA", "FL"))
    keyed = keyed.withColumn("trim", filename_key(F.col("imageID"), F.col("study"), "result"))
    return left_join(keyed, table, ["trim"])
