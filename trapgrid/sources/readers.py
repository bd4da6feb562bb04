"""CSV scans with explicit schemas, and file listings.

Files are read as the field teams' tools write them: a quote inside a quoted field is doubled, a quoted field may
hold line breaks, an empty field and the text NA are missing. Line order is kept as a position where it is asked for.
"""

from __future__ import annotations

import csv
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid import schemas
from trapgrid.operators.aggregates import unreadable
from trapgrid.operators.reshape import from_camera_lines
from trapgrid.session import checkpointed, known_to_workers, listing_tasks, shuffle_partitions

_QUOTES = {"quote": '"', "escape": '"'}
_MISSING = ("", "NA")
#: Bytes of a file that are read at a time for its header.
_HEAD = 4096
#: Files up to this many bytes are read whole by one task each, so that their records may go over several lines.
WHOLE = 256 << 20
#: Kinds of headers whose files are scanned one kind after the other.
_KINDS = 16


def _fields(spark: SparkSession, schema: str) -> list[T.StructField]:
    return spark.createDataFrame([], schema).schema.fields


def _cast(raw: DataFrame, fields: list[T.StructField], extra: dict[str, Column], watch: Observation | None) -> DataFrame:
    """Rows of texts (_f0, _f1, ...) with the columns `fields`; `watch` gets the number of texts of each that are no such value."""
    given = [F.when(~F.col(f"_f{i}").isin(*_MISSING), F.col(f"_f{i}")) for i in range(len(fields))]
    values = [text.try_cast(f.dataType) for text, f in zip(given, fields)]
    if watch is not None:
        raw = raw.observe(watch, *[unreadable(text, value).alias(f.name) for text, value, f in zip(given, values, fields)])
    return raw.select(*[value.alias(f.name) for value, f in zip(values, fields)], *extra)


def _places(texts: list[Column]) -> list[Column]:
    return [text.alias(f"_f{i}") for i, text in enumerate(texts)]


def _listed(spark: SparkSession, path, **options) -> DataFrame:
    """(file, url, length) of the files at `path`; their contents are not read."""
    given = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    return spark.read.format("binaryFile").options(**given).load(path).select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("url"), "length")


def header_names(line: str) -> list[str]:
    """The column names of a header line, by the rules that hold for rows."""
    return next(csv.reader([line.removeprefix("\ufeff").rstrip("\r\n")]), [])


def _head(path: str, size: int = _HEAD) -> str | None:
    """The first line of a file, of which no more is read than that takes; None if it cannot be opened here or is empty."""
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(path)
    except (ValueError, OSError):  # a store that only Spark reaches
        return None
    with store.open_input_file(name) as file:
        held = b""
        while b"\n" not in held:
            more = file.read(size)
            if not more:
                break
            held += more
    return held.split(b"\n", 1)[0].decode(errors="replace") or None


def _headers(spark: SparkSession, path, fields: list[T.StructField], **options) -> DataFrame:
    """(file, url, length, header, places): the header line of each file with data and where the wanted columns stand in it.

    Tasks read the first kilobytes of the files they are given. Only where they cannot open a file themselves is it scanned as text.
    """
    wanted = [f.name for f in fields]
    form = pa.schema([("file", pa.string()), ("url", pa.string()), ("length", pa.int64()), ("header", pa.string()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                line = _head(row["url"])
                names = header_names(line) if line is not None else []
                row |= {"header": line, "places": [names.index(w) if w in names else None for w in wanted]}
            yield pa.RecordBatch.from_pylist(rows, schema=form)

    known_to_workers(spark)
    dealt = _listed(spark, path, **options).where("length > 0").repartition(shuffle_partitions(spark), "file")
    heads = checkpointed(dealt.mapInArrow(run, "file string, url string, length long, header string, places array<int>"))
    unread = heads.where("header is null")
    if unread.isEmpty():
        return heads
    lines = spark.read.text([r.file for r in unread.select("file").collect()])
    first = lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("url"), "value", F.monotonically_increasing_id().alias("at"))
    found = first.groupBy("url").agg(F.min_by("value", "at").alias("header"))
    clean = F.regexp_replace("header", "^\\uFEFF|\\r$", "")
    names = F.transform(F.split(clean, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.replace(F.trim(x, F.lit('"')), F.lit('""'), F.lit('"')))
    places = F.array(*[F.nullif(F.array_position(names, w).cast("int") - 1, F.lit(-1)) for w in wanted])
    rest = unread.select("file", "url", "length").join(found, "url").select("file", "url", "length", "header", places.alias("places"))
    return checkpointed(heads.where("header is not null").union(rest))


def _rows(spark: SparkSession, files, places: list[int], large: bool, headers: list[str] | None, extra: dict[str, Column], **options) -> DataFrame:
    """Rows of files whose wanted columns stand at `places`; `headers` are the header lines of large files, None where files have none.

    Small files are read record by record, so that a quoted field may hold line breaks. Large ones are split, line by line; there a
    record that goes over its line has an odd number of quotes and is an error.
    """
    width = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(max(places) + 1)])
    more = [c.alias(n) for n, c in extra.items()]
    if not large:
        lines = spark.read.schema(width).options(header=headers is not None, multiLine=True, **_QUOTES, **options).csv(files)
        return lines.select(*_places([F.col(f"_c{place}") for place in places]), *more)
    lines = spark.read.options(**options).text(files)
    if headers:
        known = [mark + line for line in headers for mark in ("", "\ufeff")]
        lines = lines.where(~((F.col("_metadata.file_block_start") == 0) & F.col("value").isin(known)))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    told = F.concat(F.lit("a record goes over several lines of a file too large to be read whole: "), F.col("_metadata.file_path"))
    whole = F.when(quotes % 2 == 0, F.col("value")).otherwise(F.raise_error(told))
    form = ", ".join(f"{f.name} string" for f in width)
    parsed = lines.where(F.length("value") > 0).select(F.from_csv(whole, form, _QUOTES).alias("_row"), *more)
    return parsed.select(*_places([F.col(f"_row._c{place}") for place in places]), *extra)


def _by_name(
    spark: SparkSession, path, schema: str, extra: dict[str, Column], one_header: bool = False, whole_up_to: int = WHOLE, watch: Observation | None = None, **options
) -> DataFrame:
    """Rows of the files at `path` with the columns of `schema`, found by name in each file's own header, and the columns `extra`.

    The headers are looked at first, in the first kilobytes of each file. Files are then scanned once, those of a kind (wanted columns at
    the same places) together. `one_header` vouches that all files have the first one's header and, above `whole_up_to` bytes,
    no line breaks in fields. A file without one of the columns is an error.
    """
    fields = _fields(spark, schema)
    with listing_tasks(spark):
        texts = _texts(spark, path, fields, extra, one_header, whole_up_to, **options)
    return _cast(texts, fields, extra, watch)


def _texts(spark: SparkSession, path, fields: list[T.StructField], extra: dict[str, Column], one_header: bool, whole_up_to: int, **options) -> DataFrame:
    """The wanted columns as texts, whatever the headers."""
    if one_header:
        small = _listed(spark, path, **options).where(F.col("length") > whole_up_to).isEmpty()
        lines = spark.read.options(header=True, enforceSchema=False, multiLine=small, **_QUOTES, **options).csv(path)
        return lines.select(*_places([F.col(f"`{f.name}`") for f in fields]), *[c.alias(n) for n, c in extra.items()])
    headers = _headers(spark, path, fields, **options).withColumn("large", F.col("length") > whole_up_to)
    absent = headers.where(F.exists("places", lambda p: p.isNull())).limit(1).collect()
    if absent:
        missing = [f.name for f, p in zip(fields, absent[0].places) if p is None]
        raise ValueError(f"{absent[0].file} with the columns {header_names(absent[0].header)} lacks {missing}")
    kinds = headers.groupBy("places", "large").count().orderBy(F.desc("count"), "places", "large").limit(_KINDS + 1).collect()
    if not kinds:
        return _rows(spark, path, list(range(len(fields))), False, [], extra, **options)
    if len(kinds) == 1 and not kinds[0].large:
        return _rows(spark, path, list(kinds[0].places), False, [], extra, **options)
    many = len(kinds) > _KINDS
    parts = []
    for kind in headers.where("large").select("places", "large").distinct().collect() if many else kinds:
        own = headers.where((F.col("places") == F.array(*[F.lit(p) for p in kind.places])) & (F.col("large") == kind.large)).select("file", "header").collect()
        known = sorted({r.header.removeprefix("\ufeff").rstrip("\r") for r in own}) if kind.large else []
        parts.append(_rows(spark, [r.file for r in own], list(kind.places), kind.large, known, extra))
    if many:
        parts.append(_told_apart(spark, headers.where("not large"), fields, extra))
    return reduce(DataFrame.unionByName, parts)


def _told_apart(spark: SparkSession, headers: DataFrame, fields: list[T.StructField], extra: dict[str, Column]) -> DataFrame:
    """Rows of small files with many kinds of headers, each matched with the places of its own file."""
    widest = headers.agg(F.max(F.array_max("places"))).first()[0]
    width = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(widest + 1)])
    lines = spark.read.schema(width).options(header=True, multiLine=True, **_QUOTES).csv([r.file for r in headers.select("file").collect()])
    rows = lines.select(F.array(*width.names).alias("_row"), F.col("_metadata.file_path").alias("_path"), *[c.alias(n) for n, c in extra.items()])
    joined = rows.join(headers.select(F.col("url").alias("_path"), F.col("places").alias("_places")), "_path")
    return joined.select(*_places([F.get("_row", F.get("_places", F.lit(i))) for i in range(len(fields))]), *extra)


def line_position() -> Column:
    """Where a scanned row stands: file, where its block begins, and a number that counts up in the block.

    Positions of rows read by one scan compare as the lines of the files do, file after file by path; nothing is sorted for them.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )


def read_table(
    spark: SparkSession, path: str | list[str], schema: str, one_header: bool = False, position: str | None = None, watch: Observation | None = None
) -> DataFrame:
    """CSV files with a header line. Columns are found by name, whatever their place, which may differ from file to file;
    further columns of the files are left out. `position` names a column with the place of each line (see line_position).

    What is no value of its column's type becomes null; `watch` has the number of these by column after the first action on
    the rows, without a further pass.
    """
    return _by_name(spark, path, schema, {position: line_position()} if position else {}, one_header, watch=watch)


def read_headerless(spark: SparkSession, path: str | list[str], schema: str, position: str | None = None, whole_up_to: int = WHOLE) -> DataFrame:
    """CSV files without a header line, columns by place."""
    fields = _fields(spark, schema)
    large = not _listed(spark, path).where(F.col("length") > whole_up_to).isEmpty()
    extra = {position: line_position()} if position else {}
    return _cast(_rows(spark, path, list(range(len(fields))), large, None, extra), fields, extra, None)


def read_wide(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A wide occupancy table, as write_wide writes it, as (camID, year, interval, occ), whatever its number of columns.

    All files have one header; a file with another one is an error.
    """
    heads = [r.header.removeprefix("\ufeff").rstrip("\r") for r in _headers(spark, path, []).select("header").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"{path} has no data" if not heads else f"the files of {path} have different headers")
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))
    return from_camera_lines(lines.where((F.length("line") > 0) & (F.col("line") != heads[0])), header_names(heads[0]))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_metadata_folder(spark: SparkSession, folder: str, schema: str = schemas.BURST_METADATA) -> DataFrame:
    """All metadata CSVs of a folder as one table, with the file each row came from."""
    return _by_name(spark, folder, schema, {"SourceCSV": F.col("_metadata.file_path")}, recursiveFileLookup=True)


def _below(root: str) -> Column:
    """The path of a row's file below `root`."""
    path, top = F.col("_metadata.file_path"), root.rstrip("/").split(":", 1)[-1] + "/"
    plain = F.when(F.contains(path, F.lit("%")), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    at = F.locate(top, plain)
    return F.when(at > 0, F.substring(plain, at + F.lit(len(top)), F.length(plain))).otherwise(plain)


def _after(text: Column, mark: str) -> Column:
    return F.when(F.startswith(text, F.lit(mark)), F.substring(text, len(mark) + 1, F.length(text))).otherwise(text)


def read_camera_folders(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """Files `pattern` in the folders below `root`: one folder per camera, and in it, where there are any, one per check.

    `camera` is the name of the folder below `root`, `check_num` that of the one in it (null without); in
    both a name as in camera=FL01 counts by what follows the sign.
    """
    # Plain searches, as every row is given its folders.
    below = _below(root)
    two = F.substring_index(below, "/", 2)
    camera = _after(F.substring_index(below, "/", 1), "camera=")
    check = F.when(two != below, _after(F.substring_index(two, "/", -1), "check_num="))
    # Without a base path Spark would take names with a sign for columns of its own.
    return _by_name(spark, root, schema, {"camera": camera, "check_num": check}, recursiveFileLookup=True, pathGlobFilter=pattern)


def read_exported_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV that the metadata tool wrote, cut to file, name and time."""
    return read_table(spark, path, schemas.EXPORTED_METADATA)


def read_listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) from listing files, one path and, after a tab, its length per line, as the inventory of a store
    or a recursive listing gives them. A table like any other: tasks read it, whatever the number of files listed."""
    lines = spark.read.schema("path string, length long").options(sep="\t", quote="", header=False).csv(path)
    return lines.where(F.col("path").isNotNull())


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below `folder`; paths are relative to it, contents are not read.

    The driver keeps the index of the files, so this is for folders of up to some hundred
    thousand on stores that only Spark reaches; empty files are left out. For all files, of any number, use listing.walk_files or read_listing.
    """
    with listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    relative = F.regexp_replace("path", "^.*?" + _literal(folder.rstrip("/").split(":", 1)[-1]) + "/", "")
    return files.select(relative.alias("path"), "length")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
