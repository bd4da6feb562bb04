"""From prediction and metadata files to the image table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.functions.clock import calendar_parts, parse_photo_time, to_utc
from trapgrid.functions.labels import camera_of, prediction_key, study_label
from trapgrid.functions.text import paste
from trapgrid.operators.joins import first_per_key, heavy_of_counts, left_join
from trapgrid.operators.ranking import add_dense_code
from trapgrid.session import checkpointed

# Time zone and place of the studies, under each name they go by.
_CA = (34.9, -118.7, "US/Pacific")
_FL = (27.1, -81.1, "US/Eastern")
SITES = {"CA": _CA, "tejon": _CA, "tejon_TAG": _CA, "TAG": _CA, "FL": _FL, "florida": _FL}


def site_value(study: Column, item: int) -> Column:
    """Latitude (0), longitude (1) or zone (2) of a study, null if it has none."""
    out = None
    for name, values in SITES.items():
        hit = study == name
        out = F.when(hit, values[item]) if out is None else out.when(hit, values[item])
    return out


def add_burst_key(metadata: DataFrame, source: str = "SourceCSV") -> DataFrame:
    """Adds unique_chk (the directory's rank within its file), chk_burst, camID, cam_chk_burst."""
    coded = add_dense_code(metadata, [source], "Directory", "unique_chk")
    keyed = coded.withColumns(
        {"chk_burst": paste(F.col("unique_chk"), F.col("EventNumber")), "camID": camera_of(F.col("FileName"))}
    )
    return keyed.withColumn("cam_chk_burst", paste(F.col("camID"), F.col("chk_burst")))


def append(*tables: DataFrame) -> DataFrame:
    """Tables one after the other, columns matched by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def label_predictions(predictions: DataFrame, tag_label: str = "TAG") -> DataFrame:
    """Predictions with study and file name."""
    path = F.col("IMG_PATH")
    return predictions.withColumns({"study": study_label(path, tag_label), "FileName": prediction_key(path)})


def deduplicate(metadata: DataFrame, order: list[str]) -> DataFrame:
    """One row per FileName, the first by `order`."""
    return first_per_key(metadata, ["FileName"], order)


def image_table(
    predictions: DataFrame, metadata: DataFrame, complete_only: bool = False, metadata_unique: bool = False
) -> DataFrame:
    """Labelled predictions joined to metadata on FileName, dated rows only, with calendar parts.

    `study` comes from the predictions. DateTimeOriginal becomes the wall clock of the camera
    and DateTimeUTC the instant by the study's zone, null for a study whose zone is not known. `complete_only` drops rows with any
    missing value before dates are read.
    """
    right = metadata.drop(*[c for c in metadata.columns if c in predictions.columns and c != "FileName"])
    joined = left_join(predictions, right, ["FileName"], metadata_unique, salt_by=["ROW_NUM"])
    if complete_only:
        joined = joined.dropna("any")
    wall = parse_photo_time(F.col("DateTimeOriginal"))
    dated = joined.withColumn("DateTimeOriginal", wall).where(F.col("DateTimeOriginal").isNotNull())
    zone = site_value(F.col("study"), 2)
    return dated.withColumns(
        {
            "camID": camera_of(F.col("FileName")),
            "DateTimeUTC": to_utc(F.col("DateTimeOriginal"), zone),
            **calendar_parts(F.col("DateTimeOriginal")),
        }
    )


def burst_filtered(images: DataFrame, thresh: float, burst: str = "cam_chk_burst") -> DataFrame:
    """Images of bursts whose best confidence is above `thresh`, with b_max and b_min.

    Bursts are aggregated first and joined back, so that a burst with very many images (such
    as the missing one) is never sorted in one task.
    """
    return with_burst_extremes(images, burst).where(F.col("b_max") > thresh)


def _extremes() -> list[Column]:
    return [F.max("CONFIDENCE1").alias("b_max"), F.min("CONFIDENCE1").alias("b_min")]


def burst_extremes(images: DataFrame, burst: str = "cam_chk_burst") -> DataFrame:
    return images.groupBy(burst).agg(*_extremes())


def with_burst_extremes(images: DataFrame, burst: str = "cam_chk_burst") -> DataFrame:
    """Every image with the best and worst confidence of its burst.

    The burst sizes that tell which bursts are heavy come from the same aggregate, which is
    kept in the shared folder because it is read three times.
    """
    sized = checkpointed(images.groupBy(burst).agg(*_extremes(), F.count("*").alias("_size")))
    heavy = heavy_of_counts(sized, [burst], "_size")
    return left_join(images, sized.drop("_size"), [burst], right_unique=True, heavy=heavy)
