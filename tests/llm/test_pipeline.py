"""The pipeline against brute force on a small fixture, and the registered queries."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from trapgrid.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    good = [brute.prose(300 + i, 90) for i in range(12)]
    item = " ".join(brute.prose(77, 20).split()[:16])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(20, good[0], "en", "s", 1), (21, good[1] + " end", "en", "s", 1), (22, good[2] + " " + item, "en", "s", 1)]
    rows += [(23, "Own text " + brute.prose(900, 80) + f" {item} ", "de", None, 1), (24, None, None, None, None), (25, "short", "en", "s", 5)]
    rows += [(26, brute.prose(901, 90) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + brute.prose(902, 20), "en", "s", 1), rows[3], (None, brute.prose(903, 90), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, item


def test_stages(spark, folder):
    root, rows, item = folder
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), list(rows)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries_stored(stage(spark, docs, root), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect())
    kept = [r for r in kept if not brute.quality_facts(r[1])[5]]
    assert after["quality rules"] == sorted((-1 if r[0] is None else r[0], r[1]) for r in kept)
    classes = brute.near_classes([r[:2] for r in kept])
    kept = list({(r[0], r[1]): r for r, c in zip(kept, classes) if c[0] == c[2]}.values())
    assert after["MinHash near-dedup"] == sorted((-1 if r[0] is None else r[0], r[1]) for r in kept)
    found = brute.hits([r[1] for r in kept], [(1, item)])
    kept = [r for r, (n, h, _) in zip(kept, found) if not (h and 20 * h >= n)]
    assert after["benchmark decontamination"] == sorted((-1 if r[0] is None else r[0], r[1]) for r in kept)
    assert [d for d, _ in after["secret scans"]] == sorted(-1 if r[0] is None else r[0] for r in kept)
    whole = dict(after["benchmark decontamination"])
    assert {d for d, t in after["secret scans"] if t != whole[d]} == {26}
    assert dict(after["secret scans"])[26] == whole[26].replace("0123456789abcdef0123456789abcdef01234567", "[secret]")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_stage_removes_failing_lines(spark):
    body = brute.prose(5, 90)
    rows = [(1, f"Home\n{body}\nAll rights reserved.\n", "en", "s", 7), (2, body, "en", "s", 7), (3, "Home\n" * 60, "en", "s", 7), (4, None, "en", "s", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.quality_stage(spark, docs, "").collect())
    assert got == [(1, body + "\n", len(body) + 1), (2, body, 7)]
    clash = docs.withColumnRenamed("source", "Quality").withColumnRenamed("lang", "was")
    kept = corpus_pipeline.quality_stage(spark, clash, "")
    assert kept.columns == clash.columns and {r.Quality for r in kept.collect()} == {"s"}


@pytest.mark.parametrize("scanned", [False, True])
def test_one_row_of_each_group(spark, tmp_path, scanned):
    """One id with two texts, missing ids, repeated rows, and texts without words."""
    a, b, c, d = (brute.prose(40 + i, 90) for i in range(4))
    rows = [(5, a), (5, b), (5, a), (7, a + " end"), (None, a), (None, c), (None, c), (None, c + " end"), (None, d), (8, d + " end"), (9, None), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumnRenamed("lang", "file").repartition(3)
    if scanned:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    kept = [x for x in found if x[1] not in (c, c + " end")]
    assert sorted(kept, key=repr) == sorted([(5, a), (5, b), (8, d + " end"), (9, None), (9, ""), (None, None)], key=repr)
    assert len(found) == len(kept) + 1 and all(i is None for i, t in found if t in (c, c + " end"))


def test_empty_table(spark, folder):
    root, _, _ = folder
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, root)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def queries_stored(df, name):
    from trapgrid.llm.frames import stored

    return stored(df, name.replace(" ", "-"))


def test_run(spark, folder):
    root, _, _ = folder
    pytest.importorskip("public_tokenizers")
    pieces = corpus_pipeline.run(spark, root).collect()
    assert len({r.doc_id for r in pieces}) >= 12


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(n for n in queries.llm_queries() if n not in queries.llm_oracles()))
def test_query(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    rows = queries.llm_queries()[name](spark, SF_DIR)
    key = "page_id" if name.startswith("op1_") else "doc_id"
    if key in rows.columns and not name.startswith(("op2_", "op9_")):
        assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
    else:
        assert rows.count() > 0
