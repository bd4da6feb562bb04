"""Token id matrices for training: best-fit-decreasing packing, binary rows, segment bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trapgrid.llm.frames import arrow_map
from trapgrid.llm.packing import TASK_STEP, blocks


class RoomTree:
    """Which amounts of free room occur, as a segment tree over the amounts 0 to `size`."""

    def __init__(self, size: int):
        self._width = 1 << size.bit_length()
        self._count = [0] * (2 * self._width)
        self._rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self._width
        while at:
            self._count[at] += by
            at >>= 1

    def add(self, row: int, room: int) -> None:
        self._rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room that is at least `least`, and that room; it is taken out."""
        at = least + self._width
        if not self._count[at]:
            # Up until a right neighbour holds something, then down to its left-most entry.
            while at > 1 and (at & 1 or not self._count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self._width:
                at = 2 * at if self._count[2 * at] else 2 * at + 1
        room = at - self._width
        self._change(room, -1)
        return self._rows[room].pop(), room


def best_fit(lengths: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length). Documents over `size` are split into runs of `size`
    and a rest; runs and documents go, from the longest down, where they leave the least room."""
    pieces = [(min(size, n - s), d, s) for d, n in enumerate(lengths.tolist()) for s in range(0, n, size)]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    rows: list[list[tuple[int, int, int]]] = []
    tree = RoomTree(size)
    for n, d, s in pieces:
        found = tree.take(n) if n < size else None
        if found is None:
            rows.append([])
            found = (len(rows) - 1, size)
        row, room = found
        rows[row].append((d, s, n))
        if room > n:
            tree.add(row, room - n)
    return rows


def token_matrix(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    width: int = 2,
    block_tokens: int = 1 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per packed sequence: sequence_id, n_tokens (without padding), input_ids and
    position_ids (binary, `size` little-endian unsigned numbers of `width` bytes each, position
    0 at the start of each segment and over the padding), cu_seqlens (0, then the end of each
    segment), doc_ids and doc_starts (document of each segment and its first token's place there).

    Each task packs its documents in blocks of about `block_tokens` tokens. The pieces of a
    document that is longer than `size` hold all its tokens once. An id that does not fit `width` is an
    error. Null text: an empty document with `end_id` alone. Rows with the same or a null key are
    documents of their own; keys may be of any type. Other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("position_ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("doc_starts", T.ArrayType(T.LongType())),
        ]
    )
    number, own = np.dtype(f"<u{width}"), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * TASK_STEP
        for keys, ids, offsets in blocks(batches, tokenizer, end_id, block_tokens, key, text):
            if len(ids) and int(ids.max()) > np.iinfo(number).max or size - 1 > np.iinfo(number).max:
                raise ValueError(f"ids or positions do not fit {width} bytes")
            rows = best_fit(np.diff(offsets), size)
            out = []
            for row in rows:
                matrix, places, ends = np.full(size, pad_id, number), np.zeros(size, number), [0]
                for d, s, n in row:
                    a = ends[-1]
                    matrix[a : a + n] = ids[offsets[d] + s : offsets[d] + s + n]
                    places[a : a + n] = np.arange(n)
                    ends.append(a + n)
                out.append((ends[-1], matrix.tobytes(), places.tobytes(), ends, [keys[d] for d, _, _ in row], [s for _, s, _ in row]))
            columns = [list(x) for x in zip(*out)]
            arrow = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(own), pa.list_(pa.int64())]
            sequence = pa.array(np.arange(first, first + len(rows)))
            yield pa.RecordBatch.from_arrays(
                [sequence, *[pa.array(c, t) for c, t in zip(columns, arrow)]],
                names=schema.names,
            )
            first += len(rows)

    return arrow_map(docs.select(key, text), run, schema)


def write_token_matrix(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The matrix rows as Parquet files, one row group after the other in the order of sequence_id in each file."""
    rows.write.mode(mode).option("compression", "zstd").parquet(path)
