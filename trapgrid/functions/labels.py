"""Study labels and file-name keys cut out of image paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapgrid.functions.text import paste, piece

# Text found in a path and the study it stands for, first match wins.
STUDY_MARKS = [
    ("CPW", "CPW"),
    ("NWRC", "NWRC"),
    ("ACAM", "SREL"),
    ("FL", "FL"),
    ("CA-", "CA"),
    ("Florida", "FL"),
    ("TAG", None),
    ("Tejon", "CA"),
]
UNKNOWN_STUDY = "flag"

# Which pieces of a path make the file-name key, per path layout and study.
KEY_PIECES = {
    "list": {"NWRC": ("/", 2), "SREL": ("/", 4), "CPW": ("/", 3), "CA": ("_", 6, 7), "FL": ("_", 6, 7)},
    "result": {"SREL": ("/", 8), "CPW": ("/", 7), "CA": ("_", 6, 7), "FL": ("_", 6, 7)},
}
PHOTO_DB_PIECES = (5, 6)
PREDICTION_PIECE = 4


def study_label(path: Column, tag_label: str = "TAG") -> Column:
    """Study of an image path; `tag_label` says what TAG paths count as."""
    out = None
    for mark, study in STUDY_MARKS:
        hit, value = path.contains(mark), study or tag_label
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(UNKNOWN_STUDY)


def filename_key(path: Column, study: Column, layout: str = "list") -> Column:
    """The file name that the study's photo folder uses, null for a study without a rule."""
    if layout not in KEY_PIECES:
        raise ValueError(f"layout must be one of {sorted(KEY_PIECES)}, not {layout!r}")
    out = None
    for name, (sep, *positions) in KEY_PIECES[layout].items():
        pieces = [piece(path, sep, n) for n in positions]
        key = pieces[0] if len(pieces) == 1 else paste(*pieces)
        out = F.when(study == name, key) if out is None else out.when(study == name, key)
    return out


def photo_db_key(name: Column) -> Column:
    return paste(*[piece(name, "_", n) for n in PHOTO_DB_PIECES])


def prediction_key(path: Column) -> Column:
    return piece(path, "/", PREDICTION_PIECE)


def camera_of(file_name: Column) -> Column:
    return piece(file_name, "_", 1)
