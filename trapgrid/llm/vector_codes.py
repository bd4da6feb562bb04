"""Vector codes (product quantisation) by dual-tree Lloyd: trees over the parts of vectors and over codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.llm.frames import arrow_map, free_name, stored
from trapgrid.operators.joins import left_join

#: Rows of a block (one tree for each part position), and rows of a leaf at most.
BLOCK, LEAF = 8192, 24
#: Numbers that a block holds at most; long vectors make shorter blocks.
_NUMBERS = 1 << 22
#: What a squared distance may be at most, so that integers stay exact.
_FARTHEST = 2.0**62
#: Labels whose sums are broadcast; more go through a join that splits heavy ones.
_LABELS = 100_000


def is_whole(vector: str | Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def scaled(vector: str | Column, scale: int) -> Column:
    """floor(scale * component) of a whole vector, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


class Tree(NamedTuple):
    """A tree over rows of integers: at each level the rows, put in order, are cut into twice as many nodes.

    Node k of a level of m nodes has the rows order[k * n // m:(k + 1) * n // m]; `low` and `high` are its box, `sums` the sums
    of its rows. Levels follow one another from the root.
    """

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def _cuts(n: int, nodes: int) -> np.ndarray:
    return np.arange(nodes + 1) * n // nodes


def levels_of(n: int, leaf: int) -> int:
    """Levels below the root until no node has more than `leaf` rows; no node is empty."""
    depth = 0
    while -(-n // (1 << depth)) > leaf and 2 << depth <= n:
        depth += 1
    return depth


def build_tree(rows: np.ndarray, leaf: int) -> Tree:
    """Nodes are halved along the widest side of their box."""
    n, width = rows.shape
    order, depth = np.arange(n), levels_of(n, leaf)
    lows, highs, sums = [], [], []
    for level in range(depth + 1):
        cuts = _cuts(n, 1 << level)
        held = rows[order]
        lows.append(np.minimum.reduceat(held, cuts[:-1]))
        highs.append(np.maximum.reduceat(held, cuts[:-1]))
        sums.append(np.add.reduceat(held, cuts[:-1]))
        if level < depth and width:
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            side = (highs[-1] - lows[-1]).argmax(1)
            order = order[np.lexsort((held[np.arange(n), side[node]], node))]
    return Tree(order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums))


class Entries(NamedTuple):
    """A tree over the entries of one codebook; a node's children follow by `below`, a leaf is the entry `entry`."""

    low: np.ndarray
    high: np.ndarray
    below: np.ndarray
    entry: np.ndarray


def entry_tree(codebook: np.ndarray) -> Entries:
    """Entries halved along the widest side of their box until each stands alone."""
    low, high, below, entry, todo = [], [], [], [], [np.arange(len(codebook))]
    for own in todo:  # grows while it is gone through
        box = codebook[own]
        low.append(box.min(0))
        high.append(box.max(0))
        if len(own) == 1:
            below.append((-1, -1))
            entry.append(own[0])
            continue
        side = (high[-1] - low[-1]).argmax() if codebook.shape[1] else 0
        ranked = own[np.argsort(box[:, side], kind="stable")] if codebook.shape[1] else own
        below.append((len(todo), len(todo) + 1))
        entry.append(-1)
        todo += [ranked[: len(own) // 2], ranked[len(own) // 2 :]]
    return Entries(np.array(low), np.array(high), np.array(below), np.array(entry))


def _bounds(tree: Tree, node: np.ndarray, entries: Entries, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) squared distance between a point of each node's box and one of the entry node's."""
    low, high = tree.low[node], tree.high[node]
    apart = np.maximum(np.maximum(entries.low[other] - high, low - entries.high[other]), 0)
    far = np.maximum(entries.high[other] - low, high - entries.low[other])
    return (apart * apart).sum(1), (far * far).sum(1)


def _pruned(tree: Tree, node: np.ndarray, entries: Entries, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (node, entry node) but for those farther off than another pair of the same node is at most.

    Pairs of a node stand together. An entry that is as near as another may be stays, so that ties are left to the exact distances.
    """
    if not len(node):
        return node, other
    least, most = _bounds(tree, node, entries, other)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    nearest = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
    keep = least <= nearest
    return node[keep], other[keep]


def _opened(node: np.ndarray, entries: Entries, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair with the children of its entry node; entries stay as they are."""
    inner = entries.entry[other] < 0
    times = np.where(inner, 2, 1)
    places = np.repeat(np.arange(len(node)), times)
    second = np.r_[False, places[1:] == places[:-1]] if len(places) else np.zeros(0, bool)
    kids = entries.below[other[places], second.astype(int)]
    return node[places], np.where(inner[places], kids, other[places])


def assign(rows: np.ndarray, tree: Tree, leaf: int, codebook: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(whole nodes, rows, their entries): [(level, nodes, entries)] that have one nearest entry, and the rows that were looked at one by one.

    Both trees are gone down together: the distance bounds of a pair of nodes drop entry nodes that are too far for all rows of a node.
    """
    n = len(rows)
    entries = entry_tree(codebook)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, first = [], 0
    depth = levels_of(n, leaf)
    for level in range(depth + 1):
        # Open the entry side until it stands at entries, dropping what is too far at each step.
        while True:
            node, other = _pruned(tree, node, entries, other)
            if (entries.entry[other] >= 0).all():
                break
            node, other = _opened(node, entries, other)
        alone = np.ones(len(node), bool)
        same = node[1:] == node[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        whole.append((level, node[alone] - first, entries.entry[other[alone]]))
        node, other = node[~alone], other[~alone]
        if level == depth or not len(node):
            break
        # The children of a node come with its entries, and the pairs of a child stand together.
        size = 1 << level
        kids = np.concatenate([2 * (node - first), 2 * (node - first) + 1]) + first + size
        ranked = np.argsort(kids, kind="stable")
        node, other, first = kids[ranked], np.concatenate([other, other])[ranked], first + size
    if not len(node):
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Uncertain leaves: exact distances of each row to the entries that are left; the lower index wins a tie.
    cuts = _cuts(n, 1 << depth)
    leaves, count = np.unique(node - first, return_counts=True)
    left = np.full((len(leaves), len(codebook)), False)
    left[np.repeat(np.arange(len(leaves)), count), entries.entry[other]] = True
    sizes = cuts[leaves + 1] - cuts[leaves]
    of = np.repeat(np.arange(len(leaves)), sizes)
    at = tree.order[np.arange(len(of)) + np.repeat(cuts[leaves] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)]
    # Squared distances but for the row's own square, which all entries share.
    far = (codebook * codebook).sum(1) - 2 * (rows[at] @ codebook.T)
    far[~left[of]] = np.iinfo(np.int64).max
    best = far.argmin(1)
    return whole, at, best


def codes_of(rows: np.ndarray, tree: Tree, leaf: int, codebook: np.ndarray) -> np.ndarray:
    """The nearest entry of each row."""
    whole, at, best = assign(rows, tree, leaf, codebook)
    out = np.empty(len(rows), np.int64)
    for level, nodes, entry in whole:
        cuts = _cuts(len(rows), 1 << level)
        sizes = cuts[nodes + 1] - cuts[nodes]
        places = np.arange(sizes.sum()) + np.repeat(cuts[nodes] - np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64), sizes) if len(nodes) else np.zeros(0, np.int64)
        out[tree.order[places]] = np.repeat(entry, sizes)
    out[at] = best
    return out


def entry_sums(rows: np.ndarray, tree: Tree, leaf: int, codebook: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds to `sums` and `counts` of the entries what is nearest to each; whole nodes by the sums they hold."""
    whole, at, best = assign(rows, tree, leaf, codebook)
    for level, nodes, entry in whole:
        cuts = _cuts(len(rows), 1 << level)
        np.add.at(sums, entry, tree.sums[(1 << level) - 1 + nodes])
        np.add.at(counts, entry, cuts[nodes + 1] - cuts[nodes])
    np.add.at(sums, best, rows[at])
    np.add.at(counts, best, 1)


def _blocks(parts: int, leaf: int, names: list[str]):
    """Batches of vectors as blocks: their integers, and for each part position the tree over them, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                width = max(len(batch.column(0)[at]), 1)
                rows = batch.slice(at, min(BLOCK, max(_NUMBERS // width, 1)))
                at += rows.num_rows
                sizes = rows.column(0).value_lengths().to_numpy()
                if (sizes != sizes[0]).any() or not sizes[0] or sizes[0] % parts:
                    raise ValueError(f"vectors of {sorted(set(sizes.tolist()))[:5]} components are not cut into {parts} equal parts")
                values = rows.column(0).flatten().to_numpy().reshape(rows.num_rows, -1)
                if 4.0 * float(np.abs(values).max()) ** 2 * width >= _FARTHEST or np.abs(values).max() > np.iinfo(np.int32).max:
                    raise ValueError("components too large for exact distances")
                trees = [build_tree(part, leaf) for part in np.split(values, parts, axis=1)]
                made = [
                    pa.array([values.astype(np.int32).tobytes()]),
                    pa.array([np.stack([t.order for t in trees]).astype(np.int32).tobytes()]),
                    pa.array([np.stack([np.stack([t.low, t.high]) for t in trees]).astype(np.int32).tobytes()]),
                    pa.array([np.stack([t.sums for t in trees]).tobytes()]),
                ]
                # The other columns go along as one list a block.
                for name in names:
                    column = rows.column(rows.schema.get_field_index(name))
                    made.append(pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), column))
                yield pa.RecordBatch.from_arrays(made, names=["points", "orders", "boxes", "sums", *names])

    return run


def _read_block(row: dict, parts: int, width: int) -> list[tuple[np.ndarray, Tree]]:
    """(rows, tree) of each part position."""
    values = np.frombuffer(row["points"], np.int32).reshape(-1, parts * width).astype(np.int64)
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, len(values))
    sums = np.frombuffer(row["sums"], np.int64).reshape(parts, -1, width)
    boxes = np.frombuffer(row["boxes"], np.int32).reshape(parts, 2, sums.shape[1], width).astype(np.int64)
    return [(part, Tree(orders[p], boxes[p, 0], boxes[p, 1], sums[p])) for p, part in enumerate(np.split(values, parts, axis=1))]


def _rounds(blocks: DataFrame, books: np.ndarray, leaf: int, rounds: int) -> np.ndarray:
    """Codebooks after that many rounds; what reaches the driver has the size of the codebooks."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        held = blocks.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    for p, (rows, tree) in enumerate(_read_block(row, parts, width)):
                        entry_sums(rows, tree, leaf, held.value[p], sums[p], counts[p])
            used = np.argwhere(counts > 0)
            if len(used):
                p, e = used.T
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "sums"])

        made = arrow_map(blocks.select("points", "orders", "boxes", "sums"), run, "p long, e long, n long, sums array<long>")
        totals = made.select("p", "e", "n", F.posexplode("sums").alias("i", "x")).groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in totals.collect():
            books[r.p, r.e, r.i] = r.x // r.n
        held.unpersist()
    return books


def with_codes(
    vectors: DataFrame, name: str = "codes", vector: str = "embedding", key: str = "vec_id", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, leaf: int = LEAF
) -> tuple[DataFrame, np.ndarray]:
    """(the whole vectors with a column `name` (entry array<int>, error long), codebooks of shape (parts, entries, components)).

    Rows whose vector is null or has components that are null or not finite go. Components become floor(scale * x) and are cut
    into `parts` equal parts. Codebooks begin as the vectors with the lowest keys (null keys last, equal keys by vector; fewer vectors make shorter
    books) and go through `rounds` of Lloyd's steps; distances are exact, the lower index wins ties, means are rounded down, unused
    entries stay. `entry` has the index of each part, `error` the squared distances summed. Repeated rows are each a row. Vectors of
    different lengths, of a length that `parts` does not divide, or with integers too large for exact distances are an error; a table without
    whole vectors gives no rows and empty codebooks.

    Blocks of rows with their trees are stored once; each round reads these, and adds up what the tasks found for the entries.
    """
    if free_name(vectors, name) != name:
        raise ValueError(f"{name} is a column of the vectors")
    whole = vectors.where(is_whole(vector))
    ints = free_name(vectors, "ints")
    first = whole.select(F.col(key).alias("key"), scaled(vector, scale).alias("v")).orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    kind = T.StructType([T.StructField("entry", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    out_schema = T.StructType([*vectors.schema.fields, T.StructField(name, kind)])
    if not first:
        return vectors.sparkSession.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64)
    begin = np.array([r.v for r in first], np.int64).reshape(len(first), -1)
    if not begin.shape[1] or begin.shape[1] % parts:
        raise ValueError(f"vectors of {begin.shape[1]} components are not cut into {parts} equal parts")
    books = np.stack(np.split(begin, parts, axis=1))
    width, names = books.shape[2], vectors.columns
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in vectors.schema.fields]
    kinds = T.StructType([T.StructField(c, T.BinaryType()) for c in ("points", "orders", "boxes", "sums")])
    # Own columns go under numbers, so that theirs may have any name.
    numbered = [f"c{i}" for i in range(len(names))]
    given = whole.select(scaled(vector, scale).alias(ints), *[F.col(f"`{c}`").alias(n) for c, n in zip(names, numbered)])
    held_schema = T.StructType([*kinds.fields, *[T.StructField(n, f.dataType) for n, f in zip(numbered, lists)]])
    blocks = stored(arrow_map(given, _blocks(parts, leaf, numbered), held_schema), "vector-blocks")
    books = _rounds(blocks, books, leaf, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {c: one.column(i)[0].as_py() for i, c in enumerate(("points", "orders", "boxes", "sums"))}
                codes, error = [], 0
                for p, (rows, tree) in enumerate(_read_block(row, parts, width)):
                    code = codes_of(rows, tree, leaf, shared.value[p])
                    gap = rows - shared.value[p][code]
                    error = error + (gap * gap).sum(1)
                    codes.append(code)
                flat = pa.array(np.stack(codes, axis=1).ravel().astype(np.int32))
                entry = pa.ListArray.from_arrays(pa.array(np.arange(len(error) + 1, dtype=np.int32) * parts), flat)
                own = pa.StructArray.from_arrays([entry, pa.array(error)], names=["entry", "error"])
                yield pa.RecordBatch.from_arrays([*[one.column(4 + i).flatten() for i in range(len(names))], own], names=[*numbered, name])

    coded_schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(numbered, vectors.schema.fields)], T.StructField(name, kind)])
    return arrow_map(blocks, run, coded_schema).toDF(*names, name), books


def code_text(entry: str | Column) -> Column:
    """Two hex digits for each part, in order."""
    return F.array_join(F.transform(entry, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components of all entries, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, error: str, label: str = "label", name: str = "label_error") -> DataFrame:
    """`coded` with the sum of `error` over the rows with an equal label; null labels are one. `coded` is read twice, so store it first."""
    if free_name(coded, name) != name:
        raise ValueError(f"{name} is a column of the vectors")
    sums = stored(coded.groupBy(label).agg(F.sum(error).alias(name)), "label-errors")
    if sums.count() > _LABELS:
        return left_join(coded, sums, [label], right_unique=True)
    own = free_name(coded, "own_label")
    sums = sums.withColumnRenamed(label, own)
    return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col(own))).drop(own)
