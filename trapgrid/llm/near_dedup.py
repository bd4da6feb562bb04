"""Near-duplicate documents: set similarity join along chosen paths of minwise tokens."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.components import components
from trapgrid.llm.frames import arrow_map, free_name, stored, with_places
from trapgrid.llm.textbytes import LOWER, SPACES, Rolling, flat, mix, slices, words

#: Share of the pairs at the threshold that meet in the first node of a tree at least once.
RECALL = 0.99998
#: Bytes of a sketch: each is the lowest byte of a minwise value. Its share of equal bytes estimates the similarity with a
#: standard deviation of 0.027 at a threshold of 0.75.
SKETCH = 256
#: Pairs whose sketches agree less than the threshold by this many standard deviations are not compared in full.
DEVIATIONS = 3.7
#: Documents that one node compares exhaustively, branches of a larger node, and the most branchings.
NODE_LIMIT, BRANCHES, DEPTH = 4096, 2, 4

_WEIGHTS = np.random.default_rng(8).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trees_for(percent: int, recall: float = RECALL) -> int:
    """Independent trees that a pair at the threshold needs to share the first step of one of them with probability `recall`.

    Minwise tokens of a pair are equal with the probability of its similarity: 8 trees at 75 percent, 31 at 30.
    """
    if not 0 < percent <= 100 or not 0 < recall < 1:
        raise ValueError("percent must be from 1 to 100 and recall between 0 and 1")
    return 1 if percent == 100 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - percent / 100)))


def least_agreement(percent: int) -> float:
    """The share of equal sketch bytes from which pairs are compared in full."""
    share = percent / 100
    return share - DEVIATIONS * math.sqrt(share * (1 - share) / SKETCH)


@lru_cache(4)
def _multipliers(trees: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, trees + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and two hashes of each text's words in order."""
    low = LOWER[data]
    starts, ends, of = words(low, at, SPACES)
    names = Rolling(low).stretch(starts, ends)
    places = (np.arange(len(names)) - np.repeat(of[:-1], np.diff(of))).astype(np.uint64)
    whole = np.zeros((len(at) - 1, 2), np.uint64)
    filled = np.flatnonzero(np.diff(of))
    if len(filled):
        for k in range(2):
            whole[filled, k] = np.add.reduceat(mix(names * _WEIGHTS[5 + k] + places), of[:-1][filled])
    rolled = np.zeros(max(len(names) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled += mix(names[j : j + len(rolled)] + np.uint64(j))
    rolled = mix(rolled)
    sets = []
    for first, last in zip(of[:-1].tolist(), of[1:].tolist()):
        if last - first >= size:
            sets.append(np.unique(rolled[first : last - size + 1]))
        elif last > first:
            sets.append(mix(mix(names[first:last] + np.arange(last - first, dtype=np.uint64)).sum(keepdims=True)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets, whole


def minwise(shingles: np.ndarray, trees: int) -> np.ndarray:
    """The smallest value of each of the hash functions, of the trees and of the sketch, over a set."""
    multipliers = _multipliers(trees)
    out = np.full(trees + SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[None, first : first + 1024] * multipliers[:, None]).min(1))
    return out


def _features(size: int, trees: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows in slices(batch, "text"):
                data, at = flat(rows.column(rows.schema.get_field_index("text")))
                sets, whole = shingle_sets(data, at, size)
                keys, sketches = [], []
                for s in sets:
                    got = minwise(s, trees) if len(s) else None
                    keys.append(None if got is None else mix(got[:trees]).view(np.int64))
                    sketches.append(None if got is None else (got[trees:] & np.uint64(255)).astype(np.uint8).tobytes())
                empty = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + len(sets))),
                        rows.column(rows.schema.get_field_index("doc_id")),
                        pa.array(whole[:, 0].view(np.int64), mask=empty),
                        pa.array(whole[:, 1].view(np.int64), mask=empty),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                        rows.column(rows.schema.get_field_index("file")),
                        rows.column(rows.schema.get_field_index("at")),
                    ],
                    names=["rid", "doc_id", "c1", "c2", "n", "keys", "sketch", "file", "at"],
                )
                rid += len(sets)

    return run


def _by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one leaf after the other, from batches that are sorted by `leaf`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        leaves = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(leaves[1:] != leaves[:-1]) + 1).tolist(), len(leaves)]
        for first, last in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != leaves[first]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def _similar(sketches: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agreement) of the pairs i < j whose sketches agree in at least that share, a block of rows at a time."""
    n = len(sketches)
    for first in range(0, n, 32):
        block = sketches[first : first + 32]
        rest = sketches[first:]
        same = np.count_nonzero(block[:, None, :] == rest[None, :, :], axis=2) / SKETCH
        i, j = np.nonzero(same >= least)
        own = i < j
        yield i[own] + first, j[own] + first, same[i[own], j[own]]


def _sketch_matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, SKETCH)


def _with_partner(percent: int) -> Callable:
    """Rows that have a partner in their leaf by the sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_leaf(batches):
            found = np.zeros(table.num_rows, bool)
            for i, j, _ in _similar(_sketch_matrix(table), least_agreement(percent)):
                found[i] = found[j] = True
            if found.any():
                rids = table["rid"].to_numpy()[found]
                leaf, tree = (pa.repeat(table[c][0].as_py(), len(rids)).cast(k) for c, k in (("leaf", pa.int64()), ("tree", pa.int32())))
                yield pa.RecordBatch.from_arrays([leaf, pa.array(rids), tree], names=["leaf", "rid", "tree"])

    return run


def _small_nodes(table: pa.Table, trees: int) -> np.ndarray:
    """The small node that each row was in from the start, by tree; 0 for none."""
    nodes = np.zeros((table.num_rows, trees), np.int64)
    for row, own in enumerate(table["small"]):
        for x in own.as_py() or []:
            nodes[row, x["tree"]] = x["node"]
    return nodes


def _links(percent: int, trees: int) -> Callable:
    """Links in each leaf, as many as connect what is connected there; each confirmed on the full sets.

    Likely pairs are taken a block of rows at a time, the likeliest first, and only those of rows that are not connected yet; so
    what is held is a leaf's sketches and sets, not its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_leaf(batches):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
            tree, nodes = table["tree"][0].as_py(), _small_nodes(table, trees)
            group = np.arange(table.num_rows)
            left, right = [], []
            for i, j, same in _similar(_sketch_matrix(table), least_agreement(percent)):
                new = group[i] != group[j]
                for t in range(tree):  # pairs that were together in a small node of an earlier tree have been compared there
                    new &= (nodes[i, t] != nodes[j, t]) | (nodes[i, t] == 0)
                i, j, same = i[new], j[new], same[new]
                order = np.argsort(-same, kind="stable")
                for a, b in zip(i[order].tolist(), j[order].tolist()):
                    if group[a] == group[b]:
                        continue
                    n, m = len(sets[a]), len(sets[b])
                    if 100 * min(n, m) < percent * max(n, m):
                        continue
                    both = n + m - len(np.union1d(sets[a], sets[b]))
                    if 100 * both >= percent * (n + m - both):
                        group[group == group[a]] = group[b]
                        left.append(a)
                        right.append(b)
            rids = table["rid"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rids[left]), pa.array(rids[right])], names=["a", "b"])

    return run


def _leaves(features: DataFrame) -> DataFrame:
    """(leaf, rid, tree, first): leaves of all trees with at least two rows, each of about NODE_LIMIT rows at most; first marks
    nodes that were small from the start.

    A row's first node in a tree is given by its minwise token there. A node over the limit branches:
    by BRANCHES coordinates of the sketch, picked by a hash of the node, its rows go to the
    children of their values. What is still over the limit after DEPTH steps is cut into blocks
    by hash, and each pair of blocks is a leaf; so no pair of a large node is left out.
    """
    spark = features.sparkSession
    rows = features.select("rid", F.posexplode("keys").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "rid", "tree")
    found, level = [], 0
    while True:
        counts = rows.groupBy("node").count().where("count > 1")
        rows = stored(rows.join(counts, "node"), "paths")
        found.append(rows.where(F.col("count") <= NODE_LIMIT).select(F.col("node").alias("leaf"), "rid", "tree"))
        large = rows.where(F.col("count") > NODE_LIMIT)
        if level == DEPTH or large.isEmpty():
            break
        level += 1
        picks = F.sequence(F.lit(0), F.lit(BRANCHES - 1))
        steps = large.join(features.select("rid", "sketch"), "rid").select("node", "rid", "tree", "sketch", F.explode(picks).alias("pick"))
        place = F.pmod(F.xxhash64("node", "pick"), F.lit(SKETCH)).cast("int") + 1
        rows = steps.select(F.xxhash64("node", "pick", F.substring("sketch", place, F.lit(1))).alias("node"), "rid", "tree")
    blocks = F.ceil(F.col("count") * 2 / NODE_LIMIT).cast("int")
    dealt = large.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("rid"), blocks).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found.append(dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "rid", "tree"))
    out = found[0].withColumn("first", F.lit(True))
    for more in found[1:]:
        out = out.union(more.withColumn("first", F.lit(False)))
    return out


def _sets_of(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(rid, shingles): the full sets of the wanted rows (rid, file, at), from the texts themselves.

    A row is found by its place, which no other has, so that this moves each text once at any size and no key is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                sets, _ = shingle_sets(*flat(rows.column(1)), size)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "shingles"])

    joined = texts.select("file", "at", "text").where("text is not null").join(wanted.hint("shuffle_hash"), ["file", "at"])
    return arrow_map(joined.select("rid", "text"), run, "rid long, shingles binary")


def _grouped(texts: DataFrame, percent: int, size: int, recall: float) -> DataFrame:
    """(doc_id, n, component_id, file, at, first) of each row of `texts` (doc_id, text, file, at).

    `first` marks one row of each component: the one with the smallest id (null ids last), of several the first by place.

    Texts with equal words are one class from the start, so that copies cost nothing further. The
    classes go down independent trees, as many as `recall` asks for; leaves compare all their classes by sketch, and
    likely pairs on the full sets, which are made only for classes with a likely partner.
    """
    trees = trees_for(percent, recall)
    kind = texts.schema["doc_id"].dataType.simpleString()
    features = stored(arrow_map(texts, _features(size, trees), f"rid long, doc_id {kind}, c1 long, c2 long, n long, keys array<long>, sketch binary, file long, at long"), "near-features")
    filled = features.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "at")).alias("least")
    classes = stored(filled.groupBy("c1", "c2").agg(F.min("rid").alias("rid"), least), "near-classes")
    heads = stored(filled.join(classes.select("rid"), "rid", "left_semi").select("rid", "file", "at", "keys", "sketch"), "near-heads")
    leaves = stored(_leaves(heads.select("rid", "keys", "sketch")), "near-leaves")

    def sorted_leaves(rows: DataFrame) -> DataFrame:
        return rows.repartition("leaf").sortWithinPartitions("leaf", "rid")

    sketches = heads.select("rid", "sketch")
    likely = arrow_map(sorted_leaves(leaves.join(sketches, "rid").select("leaf", "rid", "tree", "sketch")), _with_partner(percent), "leaf long, rid long, tree int")
    likely = stored(likely, "near-likely")
    wanted = heads.join(likely.select("rid").distinct(), "rid", "left_semi").select("rid", "file", "at")
    sets = stored(_sets_of(wanted, texts, size), "near-sets")
    # Pairs are compared in the first small node that they share.
    small = leaves.where("first").groupBy("rid").agg(F.collect_list(F.struct("tree", F.col("leaf").alias("node"))).alias("small"))
    held = sketches.join(sets, "rid").join(small, "rid", "left")
    compared = likely.join(held, "rid").select("leaf", "rid", "tree", "sketch", "shingles", "small")
    links = stored(arrow_map(sorted_leaves(compared), _links(percent, trees), "a long, b long").distinct(), "near-links")
    roots = components(links)
    rooted = stored(classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "near-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("head")), "root").select("c1", "c2", "head")
    some = filled.select("doc_id", "n", "c1", "c2", "file", "at").join(named, ["c1", "c2"])
    some = some.select("doc_id", "n", F.col("head.doc_id").alias("component_id"), "file", "at", ((F.col("file") == F.col("head.file")) & (F.col("at") == F.col("head.at"))).alias("first"))
    none = features.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "file", "at", F.lit(True).alias("first"))
    return some.union(none)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return with_places(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "file", "at")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, text: str = "text", key: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """(`key`, n_shingles, component_id, kept) for each row of `docs`.

    A document's set holds the distinct shingles of `size` words (A-Z in lower case) of its whole text; a text with fewer
    words is one shingle; one without words, or null, is linked with nothing. Documents are linked if the sets
    share at least `percent` of their union; `recall` is the share of the links at that limit, or more, that are found as long as their
    nodes are small (trees_for). component_id is the smallest key that links lead to (null if all are null); kept marks
    it (also where both are null). Repeated rows with one key share the result of their text. An empty table gives no rows.
    """
    found = _grouped(_texts(docs, text, key), percent, size, recall)
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, text: str = "text", key: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """One row of each group of near-duplicates of `docs`, with all its columns: the one with the smallest key.

    Rows without a key come last: one stays where none of its group has a key. Of repeated rows with the smallest key the first by place
    stays; rows with one key and texts that are not near copies all stay, as do all rows without words. Columns may have any names.
    """
    file, at = free_name(docs, "file"), free_name(docs, "at")
    placed = with_places(docs, file, at)
    found = _grouped(placed.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(at).alias("at")), percent, size, recall)
    # The rows that go are joined as rows of ids; one plan at every size.
    gone = found.where("not first").select(F.col("file").alias(file), F.col("at").alias(at))
    return placed.join(gone.hint("shuffle_hash"), [file, at], "left_anti").select(*docs.columns)
