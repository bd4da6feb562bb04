"""Documents cut into pieces and packed into sequences whose attention cost is even."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trapgrid.llm.frames import arrow_map
from trapgrid.llm.textbytes import slices
from trapgrid.llm.tokens import encoder, texts_of

#: Sequence ids of one task start at its number times this.
TASK_STEP = 1 << 36


def attention_cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def pack_even(
    lengths: np.ndarray, size: int, linear: float = 1.0, quadratic: float = 1.0 / 1024
) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents with these lengths.

    A document of `size` tokens or more fills sequences of its own; what remains of it, and the
    shorter documents, are taken from the longest down. Each goes to the sequence with the lowest
    cost so far (linear * tokens + quadratic * tokens squared, summed over its pieces) that still
    has room; if none has, the one with the lowest cost takes as much as fits and the rest is
    placed in the same way. The last sequences are as long as powers of two and fill up too, so
    that nothing is padded.
    """
    pieces, rest, used = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        whole = n // size
        for k in range(whole):
            pieces.append((d, k * size, size, used, 0))
            used += 1
        if n % size:
            rest.append((n % size, d, whole * size))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if (total % size) >> b & 1]
    filled = [0] * len(room)
    open_ = [(0.0, s) for s in range(len(room))]
    for n, d, start in rest:
        while n:
            passed, best = [], None
            while open_:
                cost, s = heapq.heappop(open_)
                if room[s] - filled[s] >= n:
                    best = (cost, s)
                    break
                passed.append((cost, s))
            if best is None:
                best = passed.pop(0)  # the cheapest takes what fits
            for x in passed:
                heapq.heappush(open_, x)
            cost, s = best
            take = min(n, room[s] - filled[s])
            pieces.append((d, start, take, used + s, filled[s]))
            filled[s] += take
            n, start = n - take, start + take
            if filled[s] < room[s]:
                heapq.heappush(open_, (cost + attention_cost(take, linear, quadratic), s))
    return pieces


def blocks(
    batches: Iterator[pa.RecordBatch], tokenizer: str, last: int, block_tokens: int, key: str, text: str
) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, ids, offsets) of a task's documents, in runs of about `block_tokens` tokens."""
    known = encoder(tokenizer)
    keys, ids, sizes, held = [], [], [], 0
    for batch in batches:
        for rows in slices(batch, text, 1 << 20):
            got, offsets = known.encode(texts_of(rows.column(rows.schema.get_field_index(text))), last)
            keys += rows.column(rows.schema.get_field_index(key)).to_pylist()
            ids.append(got)
            sizes.append(np.diff(offsets))
            held += len(got)
            if held >= block_tokens:
                yield keys, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                keys, ids, sizes, held = [], [], [], 0
    if keys:
        yield keys, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def packed_pieces(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 1 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most `size` tokens: `key`, start, length, ids
    (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    Each task packs its own documents, in blocks of about `block_tokens` tokens (some hundred
    sequences), so that nothing is shuffled and memory is bounded. `size` must be a power of two.
    Null text: an empty document, whose only token is `end_id`. Rows with the same or a null key
    are documents of their own; keys may be of any type. Other columns are left out. An empty table gives no pieces.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    if key.lower() in {c.lower() for c in schema.names[1:]}:
        raise ValueError(f"{key} is a column of the result")
    own = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * TASK_STEP
        for keys, ids, offsets in blocks(batches, tokenizer, end_id, block_tokens, key, text):
            pieces = pack_even(np.diff(offsets), size, linear, quadratic)
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            raw = ids.astype("<u4").tobytes()
            at = (offsets[doc] + start) * 4
            cut = [raw[a : a + 4 * n] for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, own).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(cut, pa.binary()),
                    pa.array(np.diff(offsets)[doc]),
                    pa.array(sequence + first),
                    pa.array(offset),
                ],
                names=schema.names,
            )
            first += int(sequence.max()) + 1

    return arrow_map(docs.select(key, text), run, schema)
