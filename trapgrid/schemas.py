"""Schemas of the input files; a scan never infers types."""

_GUESSES = ", ".join(f"GUESS{i} int" for i in range(1, 6))
_CONFIDENCES = ", ".join(f"CONFIDENCE{i} double" for i in range(1, 6))

PREDICTIONS = f"ROW_NUM int, IMG_PATH string, {_GUESSES}, {_CONFIDENCES}"
BURST_METADATA = (
    "Directory string, FileName string, DateTimeOriginal string, Sequence int, EventNumber int"
)
PLAIN_METADATA = "Directory string, FileName string, DateTimeOriginal string"
EXPORTED_METADATA = "SourceFile string, FileName string, DateTimeOriginal string"
LABEL_LIST = "imageID string, X2 int"
CATEGORIES = "Class_ID int, className string"
PHOTO_DB_EXPORT = (
    "filename string, UnkID string, junk1 string, speciesID string, always1 string, "
    "mark_status string, db_path string"
)
DEPLOYMENTS = "camID string, SetDate string"
CLEAN_OUTPUT = (
    "X1 int, fileName string, answer int, "
    + ", ".join(f"guess{i} int" for i in range(1, 6))
    + ", "
    + ", ".join(f"confidence{i} double" for i in range(1, 6))
)
IMPORT_TABLE = "ImageID string, FileName string"
