"""Sinks. Tables are written by the tasks that hold them; nothing is gathered first."""

from __future__ import annotations

import csv
import errno
import io
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import AtomicType, BinaryType, StructType

from trapgrid.operators.ranking import with_row_number
from trapgrid.operators.reshape import camera_lines
from trapgrid.session import known_to_workers

# Quotes inside a field are doubled, missing values are written as NA and blanks at the ends of a text stay, as the readers expect.
_FORM = {"header": True, "quote": '"', "escape": '"', "nullValue": "NA", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line and no row index; missing values as NA."""
    df.write.mode(mode).options(**_FORM).csv(path)


def write_indexed(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """CSV whose first column is the row number by `order`."""
    numbered = with_row_number(df, order, "X1")
    write_table(numbered.select("X1", *df.columns), path, mode)


def write_wide(occ: DataFrame, path: str, time_int: str, mode: str = "errorifexists") -> None:
    """A long occupancy table as CSV with one line per camera and one field per interval, whatever their number.

    Each line is made from the camera's own array, without a pivot; the header line stands in every part file.
    """
    # One column holds the whole line and its name the whole header; its fields are separated and quoted already.
    plain = {"sep": "\u0001", "quote": "\u0002", "escape": "\u0002", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    camera_lines(occ, time_int).write.mode(mode).options(header=True, **plain).csv(path)


def write_image_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Image table as parquet, split so that a study or a year can be read alone."""
    even = df.hint("rebalance", "study", "year")
    even.write.mode(mode).partitionBy("study", "year").parquet(path)


def write_listing(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(path, length) as listing files, which read_listing reads."""
    df.select("path", "length").write.mode(mode).options(sep="\t", quote="", header=False).csv(path)


def write_per_camera(df: DataFrame, path: str, check_num: int, mode: str = "errorifexists") -> None:
    """One folder per camera and check below `path`, as camera=FL01/check_num=2.

    On a file system that is mounted (file:) tasks write the files themselves, as Spark's writer starts a process for each
    file there to set its rights. All other stores are left to Spark's writer, and so is a folder that has to be replaced or refused.
    """
    out = df.withColumn("check_num", F.lit(check_num))
    folder = _mounted(df.sparkSession, path)
    if folder is None or not (mode == "append" or mode in _NEW and not os.path.lexists(folder)) or not _plain(out):
        # Rebalancing puts a camera's rows together but still splits one that is too large.
        out.hint("rebalance", "camera").write.mode(mode).options(**_FORM).partitionBy("camera", "check_num").csv(path)
        return
    known_to_workers(df.sparkSession)
    df.sparkSession.dataSource.register(_CameraFiles)
    names = [c for c in out.columns if c not in ("camera", "check_num")]
    line = F.to_csv(F.struct(*[f"`{c}`" for c in names]), {k: str(v) for k, v in _FORM.items()})
    dealt = out.hint("rebalance", "camera").select(F.col("camera").cast("string").alias("camera"), F.concat(line, F.lit("\n")).alias("line"))
    lines = dealt.sortWithinPartitions("camera").write.format("camera_csv").mode("append")
    lines.options(path=folder, check=str(check_num), header=_text(names)).save()


#: Modes that do the same where there is no folder yet.
_NEW = ("errorifexists", "error", "default", "ignore", "overwrite")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that `path` is on a mounted file system; None on any other store."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme is None:
        scheme = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").split(":", 1)[0]
    return os.path.abspath(re.sub("^//[^/]*", "", rest)) if scheme == "file" else None


def _plain(df: DataFrame) -> bool:
    """Whether `df` has a camera and columns that go into a CSV line; Spark's writer says what is wrong otherwise."""
    given = {f.name: f.dataType for f in df.schema}
    told_apart = len({c.lower() for c in df.columns}) == len(df.columns) > 2
    return told_apart and {"camera", "check_num"} <= set(given) and all(isinstance(t, AtomicType) and not isinstance(t, BinaryType) for t in given.values())


def _text(values) -> str:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerow(["NA" if v is None else v for v in values])
    return text.getvalue()


#: Characters that Spark does not leave in the name of a folder.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}


def _folder_of(camera: str | None) -> str:
    """The folder that Spark gives a camera."""
    return f"camera={camera.translate(_ESCAPED) if camera else '__HIVE_DEFAULT_PARTITION__'}"


class _CameraFiles(DataSource):
    """Sink of CSV files on a mounted file system: rows are (camera, line with its end), those of a camera one after the other."""

    @classmethod
    def name(cls) -> str:
        return "camera_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _CameraWriter(self.options["path"], self.options["check"], self.options["header"])


@dataclass
class _Finished(WriterCommitMessage):
    """The folder in which a task's files wait."""

    own: str


class _CameraWriter(DataSourceArrowWriter):
    """Tasks write into folders of their own; the driver moves the cameras' folders when all tasks have finished."""

    def __init__(self, path: str, check: str, header: str):
        self._path, self._check, self._header, self._job = path, check, header, uuid.uuid4().hex
        self._waiting = f"{path}/_waiting-{self._job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        own = f"{self._waiting}/{context.partitionId()}-{context.taskAttemptId()}"
        os.makedirs(own)
        folder = file = None
        try:
            for batch in iterator:
                runs, lines, start = pc.run_end_encode(batch.column(0)), batch.column(1), 0
                for camera, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if _folder_of(camera) != folder:
                        if file is not None:
                            file.close()
                        folder = _folder_of(camera)
                        inner = f"{own}/{folder}/check_num={self._check}"
                        os.makedirs(inner)
                        file = open(f"{inner}/part-{context.partitionId():05d}-{self._job}.c000.csv", "wb")
                        file.write(self._header.encode())
                    own_lines = pa.ListArray.from_arrays([0, end - start], lines.slice(start, end - start))
                    file.write(pc.binary_join(own_lines, pa.scalar("", lines.type))[0].as_buffer())
                    start = end
        finally:
            if file is not None:
                file.close()
        return _Finished(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self._path, exist_ok=True)
        for message in messages:
            with os.scandir(message.own) as cameras:
                for camera in cameras:
                    _move(camera.path, f"{self._path}/{camera.name}")
        open(f"{self._path}/_SUCCESS", "w").close()
        shutil.rmtree(self._waiting, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self._waiting, ignore_errors=True)


def _move(source: str, target: str) -> None:
    """Gives a folder its name; where there is such a folder, its contents go there."""
    try:
        os.rename(source, target)
    except OSError as error:
        if error.errno not in (errno.ENOTEMPTY, errno.EEXIST):
            raise
        for name in os.listdir(source):
            _move(f"{source}/{name}", f"{target}/{name}")


@dataclass
class _Written(WriterCommitMessage):
    """Files that a task has finished: (where they wait, what they are to be called)."""

    files: list[tuple[str, str]]


class _NamedFiles(DataSource):
    """Sink of CSV files that rows name themselves: the first column is the path below the folder, the others are the fields."""

    @classmethod
    def name(cls) -> str:
        return "named_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedWriter(self.options["path"], schema.names[1:])


class _NamedWriter(DataSourceWriter):
    """Tasks write files under names of their own; the driver renames them when all tasks have finished, so that none is seen half written."""

    def __init__(self, path: str, names: list[str]):
        self._path, self._names = path.rstrip("/"), names
        self._waiting = f"{self._path}/_waiting-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        if "://" not in self._path and not self._path.startswith("file:"):
            return fs.LocalFileSystem(), lambda path: path
        return fs.FileSystem.from_uri(self._path)[0], lambda path: fs.FileSystem.from_uri(path)[1]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, at = self._store()
        done, name, file = [], None, None
        context = TaskContext.get()
        own = f"{self._waiting}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(at(own))
        try:
            for row in iterator:  # rows of a file follow one another
                if row[0] != name:
                    if file is not None:
                        file.close()
                    name = row[0]
                    done.append((f"{own}/{len(done)}", name))
                    file = store.open_output_stream(at(done[-1][0]))
                    file.write(_text(self._names).encode())
                file.write(_text(row[1:]).encode())
        finally:
            if file is not None:
                file.close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._store()
        for message in messages:
            for waiting, name in message.files if message else []:
                target = f"{self._path}/{name}"
                store.create_dir(at(target.rsplit("/", 1)[0]))
                store.move(at(waiting), at(target))
        store.delete_dir(at(self._waiting))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, at = self._store()
        if store.get_file_info(at(self._waiting)).type == fs.FileType.Directory:
            store.delete_dir(at(self._waiting))


def write_named(df: DataFrame, path: str, check_num: int) -> None:
    """One file CAM_checkN_to_import.csv for each `camera` of `df`, in the camera's own folder below `path`, with its other columns.

    A file's rows lie in one task, which writes them as they come; a file of that name is replaced. Cameras without a name go
    to the folder NA. Files appear when all are finished: a task that fails leaves nothing behind.
    """
    spark = df.sparkSession
    known_to_workers(spark)
    spark.dataSource.register(_NamedFiles)
    camera = F.coalesce("camera", F.lit("NA"))
    file = F.concat(camera, F.lit("/"), camera, F.lit(f"_check{check_num}_to_import.csv"))
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "camera"]
    dealt = df.select(file.alias("_file"), *texts).repartition("_file").sortWithinPartitions("_file")
    dealt.write.format("named_csv").mode("append").option("path", path).save()
