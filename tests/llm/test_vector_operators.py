"""Vector codes and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from trapgrid.llm import hard_negatives as hn
from trapgrid.llm import vector_codes as vc


def plain_codes(vectors, parts, entries, rounds, scale):
    """(codes, errors, codebooks) of (key, vector) rows, entry by entry."""
    ints = [[math.floor(scale * x) for x in v] for _, v in vectors]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    first = sorted(range(len(vectors)), key=lambda i: (vectors[i][0], ints[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, of) if k == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("spread", [3, 5000])
@pytest.mark.parametrize("width", [1, 5])
def test_dual_tree(spread, width):
    rng = np.random.default_rng(spread + width)
    for n in (1, 2, 23, 400):
        rows = rng.integers(-spread, spread, (n, width)) + rng.integers(0, 4, (n, 1)) * 9 * spread
        for k in (1, 7, 16):
            book = np.concatenate([rows[rng.integers(0, n, k)], rng.integers(-spread, spread, (2, width))])
            tree = vc.build_tree(rows, 4)
            want = ((rows[:, None] - book[None]) ** 2).sum(2).argmin(1)
            assert (vc.codes_of(rows, tree, 4, book) == want).all()
            sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
            vc.entry_sums(rows, tree, 4, book, sums, counts)
            assert (counts == np.bincount(want, minlength=len(book))).all()
            assert all((sums[e] == rows[want == e].sum(0)).all() for e in range(len(book)))


def test_far_groups_are_assigned_whole():
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0, 0], [9000, 0, 0], [0, 9000, 0], [0, 0, 9000]])
    rows = centers[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 3))
    _, looked_at, _ = vc.assign(rows, vc.build_tree(rows, 16), 16, centers)
    assert len(looked_at) < 800


VECTORS = [[0.25 * ((i * 7 + j * 5) % 11) - 1 + 0.01 * i for j in range(6)] for i in range(60)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i * 3 % 61, v, None if i % 9 == 0 else i % 4, "x", f"c{i}") for i, v in enumerate(VECTORS)]
    odd = [(900, None, 1, "x", ""), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x", ""), (902, [float("nan")] * 6, 1, "x", ""), (903, [1.0, float("-inf"), 1.0, 1.0, 1.0, 1.0], 2, "x", "")]
    return spark.createDataFrame([*rows, rows[5], *odd, (None, VECTORS[0], 2, "y", "")], "vec_id long, embedding array<float>, label int, error string, Points string").repartition(3)


def test_codes(vectors):
    given = [(r.vec_id if r.vec_id is not None else 10**9, r.embedding) for r in vectors.where("vec_id < 900 or vec_id is null").collect()]
    coded, books = vc.with_codes(vectors, "found", parts=3, entries=5, rounds=4, leaf=2)
    assert coded.columns == [*vectors.columns, "found"]
    got = sorted((r.vec_id if r.vec_id is not None else 10**9, r.found.entry, r.found.error) for r in coded.collect())
    codes, errors, want = plain_codes(given, 3, 5, 4, 4096)
    assert got == sorted((k, c, e) for (k, _), c, e in zip(given, codes, errors))
    assert books.tolist() == want
    text = ",".join(str(x) for part in want for entry in part for x in entry)
    assert vc.codebook_digest(books) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("most", [vc._LABELS, 1])
def test_label_errors(vectors, monkeypatch, most):
    monkeypatch.setattr(vc, "_LABELS", most)
    coded, _ = vc.with_codes(vectors, "found", parts=3, entries=5, rounds=1)
    rows = vc.with_label_error(coded.select("vec_id", "label", "found.error"), "error", name="total").collect()
    for label in {r.label for r in rows}:
        own = [r for r in rows if r.label == label]
        assert {r.total for r in own} == {sum(r.error for r in own)}
    assert len(rows) == 62


def test_few_and_none(spark, vectors):
    coded, books = vc.with_codes(vectors.where("vec_id = 3"), parts=2, entries=16)
    assert [(r.codes.entry, r.codes.error) for r in coded.collect()] == [([0, 0], 0)] and books.shape == (2, 1, 3)
    none, books = vc.with_codes(vectors.where("vec_id > 5000"))
    assert none.count() == 0 and none.columns[-1] == "codes" and vc.codebook_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="equal parts"):
        vc.with_codes(vectors, parts=4)
    with pytest.raises(ValueError, match="column"):
        vc.with_codes(vectors, "points")
    assert [r.c for r in spark.createDataFrame([([0, 15, 171],)], "e array<int>").select(vc.code_text("e").alias("c")).collect()] == ["000fab"]


def plain_negatives(rows, is_anchor, k=5):
    """The rows of hard_negatives, from (id, label, vector) rows."""
    ints = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for a, label, v in (r for r in ints if is_anchor(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in ints if i != a)
        for score, p, _ in [s for s in scored if s[2]][:k]:
            fit = [s for s in scored if not s[2] and -80 * score <= -100 * s[0] <= -100 * score][:k]
            out += [(a, p, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_negatives(spark, monkeypatch, clustered):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hn, "BLOCK", 64)
    base = rng.normal(size=(300, 8)) if not clustered else np.repeat(rng.normal(size=(12, 8)), 25, axis=0) + 0.05 * rng.normal(size=(300, 8))
    # A third of the rows has one label; some vectors are copies, so that scores tie.
    rows = [(i, 0 if i % 3 == 0 else i % 5, [float(np.float32(x)) for x in (base[i] if i % 17 else base[34])]) for i in range(300)]
    odd = [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [None] * 8), (1300, 1, [float("inf")] * 8), (None, 1, rows[1][2])]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, label int, embedding array<float>").withColumn("Rank", table_extra()).repartition(3)
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    monkeypatch.setattr(hn, "ANCHOR_NUMBERS", 8 * 6)  # several rounds of anchors
    got = hn.hard_negatives(table, table.vec_id % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want and want


def table_extra():
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_negatives_of_repeated_rows_and_text_labels(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1]), (2, "b", [0.9, 0.1]), (3, "c", [0.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = sorted(map(tuple, hn.hard_negatives(table, table.vec_id == 0).collect()))
    assert got == plain_negatives(rows, lambda i: i == 0) and len(got) == 4
    assert hn.hard_negatives(table, table.vec_id == 77).count() == 0
    assert hn.hard_negatives(table.limit(0), table.vec_id == 0).count() == 0


def test_cover_tree_skips_far_nodes():
    rng = np.random.default_rng(6)
    rows = np.round(1000 * np.repeat(np.eye(16), 100, axis=0) + rng.normal(size=(1600, 16)))
    ids = np.arange(1600)
    tree = hn.cover_tree(rows, ids)
    assert len(tree.begin) > 16 and sorted(tree.order.tolist()) == list(range(1600))
    for k in range(len(tree.begin)):
        own = rows[tree.order[tree.begin[k] : tree.end[k]]]
        extra = np.sqrt(tree.most - (own * own).sum(1)) - np.sqrt(tree.most - (rows[tree.center[k]] ** 2).sum())
        far = np.sqrt(((own - rows[tree.center[k]]) ** 2).sum(1) + extra**2)
        assert far.max() <= tree.radius[k] + 1e-6
    seen = []
    found = hn.Found(np.full((1, 1), -np.inf), np.full((1, 1), np.inf), 5)
    real, found.add = found.add, lambda a, i, s: (seen.extend(i.tolist()), real(a, i, s))
    o = tree.order
    hn.search(tree, rows[o], ids[o], np.zeros(1600, int), rows[:1], ids[:1], np.zeros(1, int), True, found)
    scores = rows @ rows[0]
    assert found.ids[0, 0].tolist() == sorted(range(1, 1600), key=lambda i: (-scores[i], i))[:5]
    assert len(seen) < 400
