"""Quality rules, near-duplicates, repeats and decontamination against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trapgrid.llm import components, decontaminate, near_dedup, quality, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.documents(), brute.SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_quality_facts(docs):
    got = quality.with_quality(docs).collect()
    assert len(got) == len(brute.documents())
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute.quality_facts(r.text), r.text
        assert not (q.base_failed and q.kept)
        assert r.kept in ("x", None, "k")  # the documents' own column


def test_quality_verdict(spark):
    good = brute.prose(7, 120)
    marked = " ".join(w + "###" for w in good.split())
    links = " | ".join(brute.prose(8, 120).split())
    rows = [(1, good), (2, marked), (3, links), (4, good + "\nAll rights reserved.\nHome\n"), (5, good + "\n" + marked + marked)]
    got = {r.doc_id: r.quality.kept for r in quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    clean = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", quality.cleaned_text(F.col("text")).alias("t")).collect()
    assert {r.doc_id: r.t for r in clean}[4].rstrip("\n") == good


def test_quality_is_native(docs):
    assert "Python" not in quality.with_quality(docs)._jdf.queryExecution().toString()


def test_near_duplicates(docs):
    got = near_dedup.near_duplicates(docs).collect()
    want = brute.near_classes([r[:2] for r in brute.documents()])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """With nodes of four documents nearly all nodes branch, and what is left is compared in blocks."""
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 4)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    base = brute.prose(3, 150).split()
    rows = [(i, " ".join(w if (j + i) % 40 else f"w{i}x{j}" for j, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, brute.prose(200 + i, 60)) for i in range(10)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute.near_classes(rows))


@pytest.mark.parametrize("percent", [75, 30])
def test_recall_on_graded_pairs(spark, percent):
    """Pairs of texts from the threshold to a tenth above it are linked, all but the few that the target recall leaves."""
    pick, rows = random.Random(percent), []

    def alike(a, b):
        one, other = brute.shingles(" ".join(a)), brute.shingles(" ".join(b))
        return 100 * len(one & other) / len(one | other)

    for i in range(250):
        words = [f"w{pick.randrange(50_000)}" for _ in range(200)]
        least, near, further = pick.uniform(percent, percent + 10), words, words
        while alike(words, further) >= least:
            near, further = further, list(further)
            further[pick.randrange(200)] = f"c{pick.randrange(50_000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(250))
    assert sum(got[2 * i + 1] == 2 * i for i in range(250)) >= 249


def test_trees_follow_the_target():
    assert near_dedup.trees_for(75) == 8 and near_dedup.trees_for(100) == 1 and near_dedup.trees_for(75, 0.9) == 2
    assert all(1 - (1 - p / 100) ** near_dedup.trees_for(p, r) >= r for p in (20, 30, 50, 75, 90) for r in (0.5, 0.9, 0.999))
    for wrong in ((0, 0.9), (101, 0.9), (75, 1.0)):
        with pytest.raises(ValueError):
            near_dedup.trees_for(*wrong)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 70), (7, 7)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert {roots[i] for i in range(41)} == {0} and roots[100] == roots[50] == roots[70] == 50


def test_repeats(spark):
    rows = [r[:2] for r in brute.documents() if r[0] is not None]
    unique = list({d: (d, t) for d, t in reversed(rows)}.values())
    want = brute.repeats(unique)
    table = spark.createDataFrame([*unique, unique[0]], "doc_id long, text string").repartition(4)
    got = suffix_dedup.without_repeats(table).collect()
    assert len(got) == len(unique) + 1
    for r in got:
        assert (r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_repeats_of_edges(spark):
    """Strings of exactly 100 bytes, of 99, periods, and a passage at the start, middle and end."""
    p = brute.prose(11, 60)[:140]
    rows = [(1, p[:100]), (2, "x" + p[:100] + "y"), (3, "q" * 350), (4, p[1:100]), (5, brute.prose(12, 30) + p + brute.prose(13, 30)), (6, p), (7, "ab" * 130), (8, "é" + p)]
    want = brute.repeats(rows)
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got} == want


def test_repeats_without_ids(spark):
    text = brute.prose(14, 100)
    got = suffix_dedup.without_repeats(spark.createDataFrame([(None, text), (None, text), (None, text + "!"), (3, text)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_bytes - r.n_removed) for r in got if r.doc_id == 3} == {(3, len(text.encode()))}
    assert sum(r.n_removed > 0 for r in got) == 3  # the table's own document comes first


ITEMS = [(1, brute.prose(99, 60)), (1, "second text of the item"), (2, "one"), (3, None), (None, brute.prose(5, 20)), (4, "... !"), (5, brute.prose(2, 13)), (6, brute.prose(2, 13))]


@pytest.mark.parametrize("size", [1 << 24, 600])
def test_benchmark_hits(spark, docs, size):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.benchmark_hits(docs, bench, automaton_bytes=size).withColumn("n_hit", decontaminate.hit_words("hits")).collect()
    want = brute.hits([r.text for r in got], ITEMS)
    assert [(r.hits.n_words, r.n_hit, r.hits["items"]) for r in got] == want
    assert any(r.n_hit for r in got)
    for r in got:
        inside = " ".join(r.text[x.start : x.end] for x in r.hits.spans) if r.text else ""
        assert len(brute.hits([inside], [])[0:1]) == 1 and brute.hits([inside], [])[0][0] == r.n_hit


def test_empty_tables(none, spark):
    assert quality.with_quality(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(none, bench).count() == 0
    texts = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontaminate.benchmark_hits(texts, bench).select("hits.items").first()[0] == []


def test_repeats_of_frequent_names(spark, monkeypatch):
    """With room for five contexts, most names are given out as pairs and settled by Spark."""
    monkeypatch.setattr(suffix_dedup, "_TOGETHER", 5)
    p = brute.prose(11, 60)[:130]
    rows = [(i, brute.prose(40 + i % 3, 15) + p[i % 4 :] + brute.prose(60 + i, 15)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.without_repeats(table).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got} == brute.repeats(rows)
