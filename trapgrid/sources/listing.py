"""Listing of folder trees by tasks, one level of folders after the other."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapgrid.session import checkpointed, known_to_workers, shuffle_partitions

_FORM = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])
#: Entries that a task holds of the folder it lists.
_ENTRIES = 8192


def _local(folder: str) -> Iterator[tuple[str, int | None, bool]]:
    """(name, length, folder) of the entries of a folder, as they come. Links to folders are not followed; a dead link has no length."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                yield entry.name, None, True
                continue
            try:
                size = entry.stat().st_size
            except FileNotFoundError:
                size = None
            if size is None or not entry.is_dir():
                yield entry.name, size, False


def _entries(root: str, below: str) -> Iterator[tuple[str, int | None, bool]]:
    if "://" not in root and not root.startswith("file:"):
        yield from _local(f"{root}/{below}")
    elif root.startswith("file:"):
        yield from _local(f"{unquote(urlparse(root).path)}/{below}")
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for entry in store.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/"))):
            folder = entry.type == fs.FileType.Directory
            yield entry.base_name, None if folder else entry.size, folder


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below `root`, paths relative to it; contents are not read.

    Tasks list the folders of one level, whose subfolders are dealt out for the next one. The driver learns only whether there are
    more, so that the number of files and folders has no bound; the depth of the tree is the number of rounds. A folder is
    listed by one task, which holds some thousand of its entries at a time on a shared drive; of a store whose URI pyarrow opens it gets
    the folder's whole list. All executors must reach `root`. Links to folders are left out. An empty tree gives no rows.
    """
    known_to_workers(spark)
    top = root.rstrip("/") or "/"
    if "://" not in top and not top.startswith("file:"):
        top = str(Path(top).absolute())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int | None, bool]] = []
        for batch in batches:
            for below in batch.column(0).to_pylist():
                for name, length, folder in _entries(top, below):
                    held.append((f"{below}/{name}" if below else name, length, folder))
                    if len(held) == _ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FORM)], schema=_FORM)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _FORM)], schema=_FORM)

    frontier, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = checkpointed(frontier.mapInArrow(run, "path string, length long, folder boolean"))
        levels.append(listed.where("not folder").select("path", "length"))
        folders = listed.where("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.union, levels)
        frontier = folders.repartition(shuffle_partitions(spark), F.xxhash64("path"))
