"""Helpers for operators that work on Arrow batches: new columns, free names, shared tables."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.llm.textbytes import slices
from trapgrid.session import new_folder


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until `df` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_tables: list[dict] = []
_running = [""]


def worker_table() -> dict:
    """A table that tasks keep in a worker for later tasks of the same operator; a task of another one empties it."""
    _tables.append({})
    return _tables[-1]


def begin_task(operator: str) -> None:
    if _running[0] != operator:
        for table in _tables:
            table.clear()
        _running[0] = operator


def _given_back(run: Callable) -> Callable:
    """`run`, after which a worker, that Spark keeps for later tasks, gives back the memory it no longer uses."""
    operator = f"{run.__module__}.{run.__qualname__}"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(operator)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
            libc.malloc_trim(0)

    return whole


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)`, with this package on the Python path of the workers.

    That is the folder the driver has it from. Where the executors do not see it, the package is to be installed or given with --py-files.
    """
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    return df.mapInArrow(_given_back(run), schema)


def with_computed(
    df: DataFrame, name: str, kind: T.DataType, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]], text: str | None
) -> DataFrame:
    """`df` with a column that `make()(rows)` computes in the tasks, over runs of rows with a few MB of `text`.

    Without a `text` the runs are of a few hundred rows. `make` is called once in each task.
    """
    names = [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            runs = slices(batch, text) if text else (batch.slice(i, 256) for i in range(0, batch.num_rows, 256))
            for rows in runs:
                yield pa.RecordBatch.from_arrays([*rows.columns, compute(rows)], names=names)

    return arrow_map(df, run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new table in the shared folder and read from there.

    A lost executor then costs only its own tasks, and several users of the rows don't compute them anew.
    """
    spark: SparkSession = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_places(df: DataFrame, file: str, at: str) -> DataFrame:
    """`df` with two columns that tell its rows apart: a hash of the row's file and its number there.

    A filtered or projected scan of parquet files has these by itself, the same in each scan, however the files are split.
    Any other table is written first.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = {re.sub(r"^[ :+|-]*'?", "", line).split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()}
    if nodes <= {"Project", "Filter", "Relation", "SubqueryAlias"} and "_metadata" not in {c.lower() for c in df.columns}:
        try:
            return df.withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})
        except AnalysisException:  # files of a kind without row numbers
            pass
    names = [f"c{i}" for i in range(len(df.columns))]
    kept = stored(df.toDF(*names), "rows").withColumns({file: F.xxhash64("_metadata.file_path"), at: F.col("_metadata.row_index")})
    return kept.toDF(*df.columns, file, at)
