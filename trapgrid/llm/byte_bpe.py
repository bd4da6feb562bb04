"""Byte-level BPE by a public file of ranks: ids of whole texts, and the bytes back from the ids."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trapgrid.llm.frames import free_name, with_computed

#: The rank of a pair that does not merge.
_NONE = (1 << 62) - 1
_PLACE = (1 << 32) - 1
#: Bytes of pieces that a worker remembers before it starts afresh, the overhead of an entry counted with each.
_REMEMBERED = 100_000_000
#: Bytes of pieces that are merged many at a time.
_SHORT = 64
#: Stretches that are put together at a time.
_AT_ONCE = 1 << 18


def read_ranks(file: bytes) -> dict[bytes, int]:
    """Rank (which is the id) of each byte string of a rank file: a string in base 64 and its rank on each line."""
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: as long as two neighbours make a string with a rank, the pair with the lowest merges, the leftmost of these first.

    A segment tree over the byte positions holds at each place the rank of the pair that begins there, and above it the
    leftmost lowest of its half. A merge changes the places of the pair, of the symbol that went and of the pair
    before: three point updates, each of logarithmic cost. A piece with a rank of its own is one id.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    half = 1 << (n - 1).bit_length()
    tree = array("q", [_NONE]) * (2 * half)
    after = array("q", range(1, n + 1))
    before = array("q", range(-1, n - 1))

    def put(first: int, end: int) -> None:
        """The pair that begins at `first` now ends before `end`; it is none if `end` is 0."""
        rank = ranks.get(piece[first:end]) if end else None
        value = _NONE if rank is None else rank << 32 | first
        node = half + first
        tree[node] = value
        while node > 1:
            value = min(value, tree[node ^ 1])
            node >>= 1
            if tree[node] == value:
                break
            tree[node] = value

    for i in range(n - 1):
        put(i, i + 2)
    while tree[1] != _NONE:
        left = tree[1] & _PLACE
        gone = after[left]
        end = after[left] = after[gone]
        put(gone, 0)
        put(left, after[end] if end < n else 0)
        if end < n:
            before[end] = left
        if left:
            put(before[left], end)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Pairs:
    """The rank that two neighbouring ids merge to, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[word[:i]] << 32 | ranks[word[i:]], rank) for word, rank in ranks.items() for i in range(1, len(word)) if word[:i] in ranks and word[i:] in ranks]
        keys = np.array([key for key, _ in found] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([rank for _, rank in found] + [0], np.int64)[order]

    def places(self, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Leaves of a segment tree: the rank of each pair and where it begins; ids under 0 merge with nothing."""
        key = left << 32 | right
        at = np.searchsorted(self._keys, key)
        return np.where((left >= 0) & (right >= 0) & (self._keys[at] == key), self._ranks[at] << 32 | first, _NONE)


def merge_many(data: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, how many of each piece) of many short pieces at once, by the steps of `merge`.

    `data` has a row of byte ids for each piece, -1 beyond its end; the width is a power of two. Each piece has a segment tree; in a
    round each piece that still has a pair makes its own next merge.
    """
    count, width = data.shape
    live = np.arange(width) < sizes[:, None]
    symbol = np.concatenate([data, np.full((count, 1), -1)], axis=1).astype(np.int64)
    places = np.tile(np.arange(width + 1), (count, 1))
    after, before = places + 1, places - 1
    tree = np.full((count, 2 * width), _NONE, np.int64)
    tree[:, width:] = pairs.places(symbol[:, :-1], symbol[:, 1:], places[:, :-1])
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        left, rank = tree[rows, 1] & _PLACE, tree[rows, 1] >> 32
        gone = after[rows, left]
        end = after[rows, gone]
        symbol[rows, left], after[rows, left], before[rows, end], live[rows, gone] = rank, end, left, False
        first = before[rows, left]
        ahead = np.where(first < 0, left, first)  # without a pair before, the leaf of the merged symbol is written twice
        own = pairs.places(rank, symbol[rows, end], left)
        leaves = width + np.stack([gone, left, ahead])
        tree[rows, leaves] = np.stack([np.full(len(rows), _NONE), own, np.where(first < 0, own, pairs.places(symbol[rows, ahead], rank, ahead))])
        nodes = leaves >> 1
        while nodes[0, 0]:
            tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            nodes >>= 1
        rows = rows[tree[rows, 1] != _NONE]
    return symbol[:, :-1][live], live.sum(axis=1)


class _Numbers(dict):
    """Pieces numbered as they turn up; `new` holds those that were not known."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Codec:
    """Encodes and decodes by one set of ranks; remembers the ids of the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._split = regex.compile(pattern).findall
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self._bytes = np.frombuffer(b"".join(words), np.uint8)
        self._ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self._known = np.zeros(len(words), bool)
        self._known[list(ranks.values())] = True
        self._byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._pairs = Pairs(ranks)
        self._clear()

    def _clear(self) -> None:
        self._held = 0
        self._number = _Numbers()
        self._ids, self._at = array("i"), array("q", [0])

    def _learn(self, pieces: list[str]) -> None:
        """Adds the ids of new pieces: those with a rank, short ones by width, and long ones one by one."""
        words = [piece.encode() for piece in pieces]
        ids: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self._ranks.get(word)
            if whole is not None:
                ids[i] = (whole,)
            elif len(word) > _SHORT:
                ids[i] = merge(word, self._ranks)
            else:
                by_width.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for width, own in by_width.items():
            for first in range(0, len(own), _AT_ONCE // width):
                some = own[first : first + _AT_ONCE // width]
                data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
                sizes = np.array([len(words[i]) for i in some])
                made, counts = merge_many(np.where(np.arange(width) < sizes[:, None], self._byte_ids[data], -1), sizes, self._pairs)
                made, ends = made.tolist(), np.cumsum(counts).tolist()
                for i, begin, end in zip(some, [0, *ends], ends):
                    ids[i] = made[begin:end]
        self._ids.extend(chain.from_iterable(ids))
        self._at.extend((self._at[-1] + np.cumsum([len(x) for x in ids])).tolist() if ids else [])
        self._held += sum(len(word) + 150 for word in words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of text i are ids[offsets[i]:offsets[i + 1]]; null is an empty text."""
        if self._held > _REMEMBERED:
            self._clear()
        split = [self._split(text or "") for text in texts]
        counts = [len(s) for s in split]
        number = np.fromiter(map(self._number.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        self._learn(self._number.new)
        self._number.new = []
        ids, at = np.frombuffer(self._ids, np.int32) if self._ids else np.zeros(0, np.int32), np.frombuffer(self._at, np.int64)
        out, before = stretches(ids, at, number)
        return out, before[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) behind runs of ids; an id that no string has is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._known) or not self._known[ids].all()):
            raise ValueError("an id without a byte string")
        out, before = stretches(self._bytes, self._ends, ids.astype(np.int64))
        return out, before[offsets]


def stretches(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches `which` of `values`, one after the other, how many values come before each and after the last).

    Stretch i is values[at[i]:at[i + 1]].
    """
    sizes = at[which + 1] - at[which]
    before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.empty(before[-1], values.dtype)
    for first in range(0, len(which), _AT_ONCE):  # places take eight bytes a value
        own = slice(first, min(first + _AT_ONCE, len(which)))
        begin, end = before[own.start], before[own.stop]
        out[begin:end] = values[np.repeat(at[which[own]] - before[own], sizes[own]) + np.arange(begin, end)]
    return out, before


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(file: bytes, pattern: str) -> Codec:
    """The worker's codec, which later tasks of the worker find with what it remembers."""
    key = (hash(file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(file), pattern)
    return _codecs[key]


def _shared(df: DataFrame, path: str):
    """The rank file, sent to the tasks: a vocabulary is about a megabyte, whatever the number of texts."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def with_token_ids(docs: DataFrame, path: str, pattern: str, name: str = "ids", text: str = "text") -> DataFrame:
    """`docs` with a column `name`, the ids (array of int) of the whole `text` by the rank file at `path`.

    Each match of `pattern` is encoded by itself. There are no special tokens: their strings are ordinary text. Null or empty text has no ids. Rows of
    any number and order keep their other columns; a column `name`, in whatever case, is an error. Pieces that a worker has met
    are looked up, so that the merges of a word are made once; a piece of n bytes costs n log n.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"{name} is a column of the documents")
    file = _shared(docs, path)

    def make() -> Callable:
        codec = _codec(file.value, pattern)

        def compute(rows: pa.RecordBatch) -> pa.Array:
            ids, at = codec.encode(_column(rows, text).to_pylist())
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))

        return compute

    return with_computed(docs, name, T.ArrayType(T.IntegerType()), make, text)


def with_decoded(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """`encoded` with a column `name`, the bytes (binary) that the array of ids stands for; null for null.

    An id that the rank file at `path` does not have is an error, as is a null among the ids.
    """
    if free_name(encoded, name) != name:
        raise ValueError(f"{name} is a column of the table")
    file = _shared(encoded, path)

    def make() -> Callable:
        codec = Codec(read_ranks(file.value), "")

        def compute(rows: pa.RecordBatch) -> pa.Array:
            column = _column(rows, ids)
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("a null among the ids")
            sizes = np.array(column.value_lengths().fill_null(0))
            data, at = codec.decode(flat.to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(at), pa.py_buffer(data)])
            return pc.if_else(column.is_valid(), whole, None).cast(pa.binary())

        return compute

    return with_computed(encoded, name, T.BinaryType(), make, None)
