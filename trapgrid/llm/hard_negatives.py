"""Hard negatives of anchors by inner product: cover trees over norm-augmented vectors, searched best first."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapgrid.llm.frames import arrow_map, stored
from trapgrid.llm.vector_codes import is_whole, scaled

#: Rows under one cover tree, and rows of a node that is not divided.
BLOCK, LEAF = 2048, 32
#: Numbers of the anchors that are broadcast at a time; all anchors are searched, in as many rounds as that takes.
ANCHOR_NUMBERS = 1 << 22
#: The mark of nodes whose rows have different labels.
_MIXED = -2


class Cover(NamedTuple):
    """A cover tree over rows: node k covers order[begin[k]:end[k]] within radius[k] of the row center[k]; its children are the
    nodes from child[k] on, `children[k]` of them, none for a leaf. `most` is the longest norm: rows are augmented to that."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    most: float


def cover_tree(rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Cover:
    """Each level halves the covering radius; a node's children are centers farther apart than that, its own center first.

    Where a quarter of a node's rows would be centers, dividing it saves nothing, and it stays a leaf. Rows of a leaf are in order of their ids.
    """
    norms = (rows * rows).sum(1)
    most = float(norms.max(initial=0.0))
    points = np.concatenate([rows, np.sqrt(most - norms)[:, None]], axis=1)
    squares = (points * points).sum(1)

    def gaps(own: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[own] + squares[center] - 2 * (points[own] @ points[center]), 0))

    every = np.arange(len(rows))
    first = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    gap = gaps(every, first)
    todo = [(every, first, float(gap.max()), gap)]
    order, begin, end, child, children, centers, radii = [], [], [], [], [], [], []
    placed = 0
    for own, center, reach, gap in todo:  # grows while it is gone through: children follow one another
        centers.append(center)
        radii.append(float(gap.max()))
        child.append(len(todo))
        groups: list = []
        if len(own) > leaf and radii[-1] > 1e-6:
            while reach >= radii[-1]:  # levels on which the node would be its own only child
                reach /= 2
            groups = _divided(own, center, gap, reach, gaps)
        children.append(len(groups))
        todo += [(members, c, reach, near) for members, c, near in groups]
    # Leaves lie in the order of a walk down the tree, so that the rows of every node are one stretch.
    begin, end = [0] * len(todo), [0] * len(todo)

    stack = [(0, False)]
    while stack:
        node, done = stack.pop()
        if done:
            end[node] = placed
            continue
        begin[node] = placed
        stack.append((node, True))
        if children[node]:
            stack += [(k, False) for k in range(child[node] + children[node] - 1, child[node] - 1, -1)]
        else:
            own = todo[node][0]
            order.append(own[np.argsort(ids[own], kind="stable")])
            placed += len(own)
    return Cover(np.concatenate(order), *[np.array(x) for x in (centers, radii, begin, end, child, children)], most)


def _divided(own: np.ndarray, center: int, gap: np.ndarray, reach: float, gaps) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(members, center, their distances) of the children: the farthest row becomes a center until all are within `reach` of one."""
    near, of, centers = gap.copy(), np.zeros(len(own), np.int64), [center]
    while near.max() > reach:
        if 4 * len(centers) >= len(own):
            return []
        centers.append(int(own[near.argmax()]))
        other = gaps(own, centers[-1])
        nearer = other < near
        of[nearer], near[nearer] = len(centers) - 1, other[nearer]
    picked = [np.flatnonzero(of == k) for k in range(len(centers))]
    return [(own[p], c, near[p]) for p, c in zip(picked, centers) if len(p)]


class Found:
    """The best `k` rows of each anchor and window so far; the lowest of them is the bar for others."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def bar(self) -> np.ndarray:
        return np.maximum(self.low, self.scores[:, :, -1])

    def add(self, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            inside = (scores >= np.maximum(self.low[anchors, w], self.scores[anchors, w, -1])) & (scores <= self.high[anchors, w])
            if not inside.any():
                continue
            touched = np.unique(anchors[inside])
            a = np.concatenate([anchors[inside], np.repeat(touched, self.k)])
            i = np.concatenate([ids[inside], self.ids[touched, w].ravel()])
            s = np.concatenate([scores[inside], self.scores[touched, w].ravel()])
            ranked = np.lexsort((i, -s, a))
            a, i, s = a[ranked], i[ranked], s[ranked]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < self.k
            self.scores[a[top], w, place[top]] = s[top]
            self.ids[a[top], w, place[top]] = i[top]


def search(tree: Cover, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, own_ids: np.ndarray, own_labels: np.ndarray, same: bool, found: Found) -> None:
    """Adds to `found` the rows under `tree` of the anchors' label, but for the anchor's id, or (not `same`) of other labels.

    In each wave every anchor takes the nodes with its highest bounds, more from wave to wave; nodes whose bounds lie outside all of its windows or
    below what it has found are skipped. Leaves that are reached are compared exactly. `rows`, `ids` and `labels` are in the tree's order.
    """
    place = np.empty(len(tree.order), np.int64)
    place[tree.order] = np.arange(len(place))
    middle = rows[place[tree.center]]
    lowest, highest = (np.array([f(labels[b:e]) for b, e in zip(tree.begin, tree.end)]) for f in (np.min, np.max))
    single = np.where(lowest == highest, lowest, _MIXED)
    square = (anchors * anchors).sum(1)
    length = np.sqrt(square)

    def bounds(a: np.ndarray, node: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) integer inner product of the anchors with rows of the nodes."""
        total, radius = square[a] + tree.most, tree.radius[node]
        gap = np.sqrt(np.maximum(total - 2 * product, 0))
        slack = length[a] * radius
        least = np.maximum((total - (gap + radius) ** 2) / 2, product - slack)
        most = np.minimum((total - np.maximum(gap - radius, 0) ** 2) / 2, product + slack)
        room = 1e-9 * total + 1e-6
        return np.ceil(least - room), np.floor(most + room)

    def open_for(a: np.ndarray, node: np.ndarray, least: np.ndarray, most: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Whether a node may hold rows that an anchor looks for."""
        label = own_labels[a]
        right = (single[node] == _MIXED) | ((single[node] == label) == same)
        return right & ((most[:, None] >= bar[a]) & (least[:, None] <= found.high[a])).any(1)

    a, node = np.arange(len(anchors)), np.zeros(len(anchors), np.int64)
    least, most = bounds(a, node, anchors @ middle[0])
    width = 1
    while len(a):
        bar = found.bar()
        keep = open_for(a, node, least, most, bar)
        a, node, least, most = a[keep], node[keep], least[keep], most[keep]
        ranked = np.lexsort((-most, a))
        a, node, least, most = a[ranked], node[ranked], least[ranked], most[ranked]
        taken = np.arange(len(a)) - np.searchsorted(a, a) < width
        width *= 2
        rest = [(a[~taken], node[~taken], least[~taken], most[~taken])]
        now, which = a[taken], node[taken]
        by_node = np.argsort(which, kind="stable")
        now, which = now[by_node], which[by_node]
        floor, roof = bar.min(1, initial=np.inf), found.high.max(1, initial=-np.inf)
        hits = []
        for own in np.split(np.arange(len(which)), np.flatnonzero(which[1:] != which[:-1]) + 1):
            if not len(own):
                continue
            one, who = which[own[0]], now[own]
            if tree.children[one]:
                kids = np.arange(tree.child[one], tree.child[one] + tree.children[one])
                product = (anchors[who] @ middle[kids].T).ravel()
                who, kids = np.repeat(who, len(kids)), np.tile(kids, len(who))
                rest.append((who, kids, *bounds(who, kids, product)))
            else:
                stretch = slice(tree.begin[one], tree.end[one])
                product = anchors[who] @ rows[stretch].T
                like = labels[stretch][None, :] == own_labels[who][:, None]
                fit = (product >= floor[who][:, None]) & (product <= roof[who][:, None]) & (like == same)
                i, j = np.nonzero(fit)
                other = ids[stretch][j] != own_ids[who[i]]
                i, j = i[other], j[other]
                hits.append((who[i], ids[stretch][j], product[i, j]))
        if hits:
            found.add(*[np.concatenate(x) for x in zip(*hits)])
        a, node, least, most = (np.concatenate(x) for x in zip(*rest))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, id, label) as blocks, each with its cover tree, rows in the tree's order."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            sizes = part.column(0).value_lengths().to_numpy()
            if (sizes != sizes[0]).any():
                raise ValueError("vectors of different lengths")
            rows = part.column(0).flatten().to_numpy().reshape(-1, max(sizes[0], 1)).astype(np.float64) if sizes[0] else np.zeros((len(sizes), 1))
            if np.abs(rows).max() ** 2 * rows.shape[1] >= 2.0**52:
                raise ValueError("components too large for exact inner products")
            ids = part.column(1).to_numpy()
            tree = cover_tree(rows, ids)
            order = pa.array(tree.order)
            nodes = np.stack([tree.center, tree.begin, tree.end, tree.child, tree.children]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[tree.order].astype(np.int32).tobytes()]),
                    pa.array([ids[tree.order].tobytes()]),
                    pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), part.column(2).take(order)),
                    pa.array([tree.order.astype(np.int32).tobytes()]),
                    pa.array([nodes.tobytes()]),
                    pa.array([tree.radius.tobytes()]),
                    pa.array([tree.most]),
                ],
                names=["rows", "ids", "labels", "place", "nodes", "radii", "most"],
            )


def _searched(trees: DataFrame, anchors: tuple, same: bool, low: np.ndarray, high: np.ndarray, k: int, id_type: str) -> DataFrame:
    """(a, w, id, score): the best `k` rows of each anchor and window, by task."""
    held = trees.sparkSession.sparkContext.broadcast((*anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, own_ids, own_labels, low, high = held.value
        codes = {label: i for i, label in enumerate(dict.fromkeys(own_labels))}
        mine = np.array([codes[label] for label in own_labels])
        found = Found(low, high, k)
        queries = vectors.astype(np.float64)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                rows = np.frombuffer(row["rows"], np.int32).reshape(len(ids), -1).astype(np.float64)
                if rows.shape[1] != queries.shape[1]:
                    raise ValueError("vectors of different lengths")
                # Labels that no anchor has are different from all, and one for this purpose.
                labels = np.array([codes.get(label, -1) for label in row["labels"]])
                center, begin, end, child, children = np.frombuffer(row["nodes"], np.int32).reshape(5, -1).astype(np.int64)
                tree = Cover(np.frombuffer(row["place"], np.int32), center, np.frombuffer(row["radii"], np.float64), begin, end, child, children, row["most"])
                search(tree, rows, ids, labels, queries, own_ids, mine, same, found)
        a, w, place = np.nonzero(found.scores > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(w), pa.array(found.ids[a, w, place]), pa.array(found.scores[a, w, place].astype(np.int64))], names=["a", "w", "id", "score"]
        )

    rows = arrow_map(trees, run, "a long, w long, id long, score long")
    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    most_percent: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that `is_anchor` marks.

    Components become floor(scale * x), scores are inner products of these. An anchor's positives are its best rows of the same label, but for
    rows with its own id; for each of them the negatives are the best rows of other labels whose score is between `least_percent`
    and `most_percent` of the positive's. Higher scores come first, ties by smaller id. Rows with a null id or label, or a vector
    that is null or has components that are null or not finite, take no part. Repeated rows are each a row, an anchor too.
    Anchors without positives and positives without negatives have no rows. Vectors of different lengths are an error, as are
    components too large for exact products; a table without rows gives none.

    Candidates are stored once in blocks, each under its cover tree. Anchors are broadcast some at a time, by a bound on
    their numbers, and each task searches its blocks for all of these; tasks send on no more than the best few of an anchor.
    """
    spark = vectors.sparkSession
    whole = vectors.where(is_whole(vector) & F.col(key).isNotNull() & F.col(label).isNotNull())
    given = whole.select(scaled(vector, scale).alias("v"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"), is_anchor.alias("anchor"))
    kind = vectors.schema[label].dataType.simpleString()
    trees = stored(arrow_map(given.select("v", "id", "label"), _trees, f"rows binary, ids binary, labels array<{kind}>, place binary, nodes binary, radii binary, most double"), "cover-trees")
    anchors = stored(given.where("anchor").select("v", "id", "label", F.monotonically_increasing_id().alias("at")), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    rounds = -(-(size.n or 0) * (size.d or 1) // ANCHOR_NUMBERS)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    parts = []
    for r in range(rounds):
        own = anchors.where(F.pmod(F.xxhash64("at"), F.lit(rounds)) == r).orderBy("at").collect()
        if not own:
            continue
        held = (np.array([x.v for x in own], np.int32).reshape(len(own), -1), np.array([x.id for x in own], np.int64), [x.label for x in own])
        if not held[0].shape[1]:
            held = (np.zeros((len(own), 1), np.int32), *held[1:])
        open_low, open_high = np.full((len(own), 1), -np.inf), np.full((len(own), 1), np.inf)
        near = stored(_searched(trees, held, True, open_low, open_high, positives, kind), "positives")
        # A positive is the window `w` of its anchor.
        low, high = np.full((len(own), positives), np.inf), np.full((len(own), positives), -np.inf)
        for x in near.collect():
            low[x.a, x["rank"] - 1] = -(-least_percent * x.score // 100)
            high[x.a, x["rank"] - 1] = most_percent * x.score // 100
        far = _searched(trees, held, False, low, high, negatives, kind)
        named = near.select("a", (F.col("rank") - 1).cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        who = spark.createDataFrame([(i, int(x)) for i, x in enumerate(held[1])], "a long, anchor_id long")
        made = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["a", "w"]).join(who, "a")
        parts.append(stored(made.selectExpr("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"))
    out = spark.createDataFrame([], schema)
    return out if not parts else parts[0] if len(parts) == 1 else out.unionByName(spark.read.schema(schema).parquet(*[f for p in parts for f in p.inputFiles()]))
