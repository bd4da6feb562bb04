"""Tables exchanged with the photo database, the classifier and the file system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapgrid.functions.clock import parse_set_date
from trapgrid.functions.labels import photo_db_key
from trapgrid.functions.text import basename, drop_last_char, paste, piece, strip_spaces
from trapgrid.operators.joins import first_match, left_join, override
from trapgrid.operators.reshape import title_case_names

# Classifier codes that have one counterpart in the photo database.
CROSSWALK = [
    (1, "Cattle", "Bos Taurus"),
    (2, "Quail", "Callipepla californica"),
    (4, "Elk", "Cervus canadensis"),
    (6, "Corvid", "Corvus spp"),
    (7, "Armadillo", "Daypus novemcinctus"),
    (8, "Turkey", "Meleagris gallopavo"),
    (9, "Opossum", "Possum"),
    (11, "Human", "Homo sapiens"),
    (13, "Bobcat", "Lynx rufus"),
    (14, "Str_Skunk", "Mephitis mephitis"),
    (15, "Deer spp", "Odocoileus spp"),
    (19, "Raccoon", "Procyon lotor"),
    (20, "Mtn Lion", "Puma concolor"),
    (22, "Wild Pig", "Sus scrofa"),
    (24, "Black bear", "Ursus americanus"),
    (25, "Vehicle", "Vehicle truck"),
    (26, "Bird", "Aves"),
]


def crosswalk(spark) -> DataFrame:
    return spark.createDataFrame(CROSSWALK, "ml_code int, ml_name string, db_name string")


def add_database_names(images: DataFrame) -> DataFrame:
    """Images with classifier and database names of GUESS1, null for codes without a counterpart."""
    codes = F.broadcast(crosswalk(images.sparkSession))  # the 17 rows above
    return images.join(codes, F.col("GUESS1") == F.col("ml_code"), "left").drop("ml_code")


def merge_photo_db(export: DataFrame, predictions: DataFrame, predictions_unique: bool = False) -> DataFrame:
    """Database export keyed by file name, left-joined to predictions, complete rows only.

    `predictions_unique` says that they have one row per file name, which saves a pass over them.

    The row-number and directory columns of the predictions are dropped afterwards, so a row
    that lacks one of them is not complete either.
    """
    left = export.select(
        F.col("filename").alias("old_filename"), "UnkID", "speciesID", photo_db_key(F.col("filename")).alias("filename")
    )
    merged = left_join(left, predictions, ["filename"], predictions_unique).dropna("any")
    return merged.drop("X1", "Directory")


def clean_classifier_output(output: DataFrame) -> DataFrame:
    """Classifier output with a bare file name and title-case columns, without index and answer."""
    name = drop_last_char(basename(F.col("fileName")))
    keep = [c for c in output.columns if c not in ("X", "X1", "fileName", "answer", "camera")]
    tidy = title_case_names(output.select(*keep))
    extra = ["camera"] if "camera" in output.columns else []
    return output.select(
        *extra, name.alias("FileName"), *[F.col(a).alias(b) for a, b in zip(keep, tidy.columns)]
    )


def to_import(output: DataFrame, import_table: DataFrame, output_unique: bool = False) -> DataFrame:
    """The import table with the classifier's guesses, for all cameras of a check at once.

    `output_unique` says that the output has one row per camera and file name, which saves a pass over it.
    """
    ids = import_table.select("camera", "ImageID", "FileName")
    return left_join(ids, clean_classifier_output(output), ["camera", "FileName"], output_unique, salt_by=["ImageID"])


def deployment_table(
    images: DataFrame, set_dates: DataFrame, overrides: dict[str, object], time: str = "DateTimeOriginal"
) -> DataFrame:
    """Each camera with the date of its last photo and its set date; `overrides` come last.

    Photos without a camera get the set date that has no camera either.
    """
    last = images.groupBy("camID").agg(F.to_date(F.max(time)).alias("end_date"))
    dates = set_dates.select(
        strip_spaces(F.col("camID")).alias("_site"), parse_set_date(F.col("SetDate")).alias("SetDate")
    )
    # Both have about one row per camera.
    joined = last.join(dates, F.col("camID").eqNullSafe(F.col("_site")), "left").drop("_site")
    return override(joined, "camID", "SetDate", overrides)


def file_manifest(wanted: DataFrame, listing: DataFrame, depth: int) -> DataFrame:
    """Wanted file names (column name) against listed paths: path, prefix and whether it was found.

    The name is piece `depth` of a listed path and the prefix the two pieces at its start;
    of several files with one name the first path is taken.
    """
    path = F.col("path")
    files = listing.select(path, piece(path, "/", depth).alias("name"))
    found = first_match(wanted, files, "name", "path")
    prefix = F.when(path.isNotNull(), paste(piece(path, "/", 1), piece(path, "/", 2), sep="/"))
    return found.select("name", "path", prefix.alias("prefix"), path.isNotNull().alias("matched"))
