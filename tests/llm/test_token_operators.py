"""Packing and token matrices: exact round trips."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from trapgrid.llm import frames, packing, token_output, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["Don't stop", "naïve café\u2028x", "a\x1cb \x85c", "<|endoftext|> y", "ﬁ Å ΑΣ. ς", "🙂🙂 x🙂", "w" * 300, None, "", brute.prose(1, 3000), brute.prose(2, 700), "1234 5,6"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "extra", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, offset string, ids int").repartition(2)


@pytest.mark.parametrize("size", [64, 2048])
def test_pieces(docs, size):
    got = packing.packed_pieces(docs, PATH, size=size, block_tokens=5000).collect()
    want = {i if i != 3 else None: ids_of(t) for i, t in enumerate(TEXTS)}
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in got:
        own = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert own == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    for doc, ids in want.items():
        assert sum(n for _, n in parts[doc]) == len(ids) * (2 if doc == 1 else 1)
        assert {k for s, n in parts[doc] for k in range(s, s + n)} == set(range(len(ids)))
    for rows in sequences.values():
        end = 0
        for offset, n in sorted(rows):
            assert offset == end
            end += n
        assert end <= size and end & (end - 1) == 0  # no padding


def test_even_cost():
    lengths = np.random.default_rng(1).integers(20, 900, 400)
    pieces = packing.pack_even(lengths, 1024)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += packing.attention_cost(n, 1.0, 1 / 1024)
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 1024]
    assert max(full) < 1.7 * np.mean(full)
    assert len(pieces) < 1.6 * len(lengths)


@pytest.mark.parametrize("size", [64, 2048])
def test_matrix(docs, size):
    got = token_output.token_matrix(docs, PATH, size=size, block_tokens=5000).collect()
    want = {i if i != 3 else None: ids_of(t) for i, t in enumerate(TEXTS)}
    parts = defaultdict(list)
    for r in got:
        ids, places = np.frombuffer(bytes(r.input_ids), "<u2"), np.frombuffer(bytes(r.position_ids), "<u2")
        assert len(ids) == len(places) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and not places[r.n_tokens :].any()
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts):
            assert ids[a:b].tolist() == want[d][s : s + b - a] and places[a:b].tolist() == list(range(b - a))
            parts[d].append((s, b - a))
    for doc, ids in want.items():
        assert sum(n for _, n in parts[doc]) == len(ids) * (2 if doc == 1 else 1)


def test_best_fit():
    lengths = np.random.default_rng(2).integers(1, 300, 500)
    rows = token_output.best_fit(lengths, 256)
    assert sum(n for r in rows for _, _, n in r) == lengths.sum()
    assert all(sum(n for _, _, n in r) <= 256 for r in rows)
    # Each piece went where least room was left: compare with a plain search.
    plain, room = [], []
    for n, d, s in sorted(((min(256, m - s), d, s) for d, m in enumerate(lengths.tolist()) for s in range(0, m, 256)), key=lambda x: (-x[0], x[1], x[2])):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if not fits:
            room.append(256)
            plain.append(0)
            fits = [(256, len(room) - 1)]
        room[min(fits)[1]] -= n
    assert sorted(room) == sorted(256 - sum(n for _, _, n in r) for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_pieces(none, PATH).count() == 0
    assert token_output.token_matrix(none, PATH).count() == 0


def test_too_narrow(docs):
    with pytest.raises(Exception, match="do not fit"):
        token_output.token_matrix(docs, PATH, width=1).count()


@pytest.mark.parametrize("kind", ["int", "string", "decimal(12,0)", "date"])
def test_keys_of_other_types(spark, kind, tmp_path):
    rows = spark.range(9).selectExpr("id", "concat('some words ', id) as text", "date_add(date'2020-01-01', cast(id as int)) as day")
    key = "day" if kind == "date" else f"cast(id as {kind})"
    docs = rows.selectExpr(f"case when id <> 4 then {key} end as doc_id", "text").repartition(2)
    want = sorted((str(r.doc_id), len(ids_of(r.text))) for r in docs.collect())
    pieces = packing.packed_pieces(docs, PATH, size=64)
    assert pieces.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted({(str(r.doc_id), r.doc_tokens) for r in pieces.collect()}) == want
    token_output.write_token_matrix(token_output.token_matrix(docs, PATH, size=64), str(tmp_path / "matrix"))
    found = []
    for r in spark.read.parquet(str(tmp_path / "matrix")).collect():  # as written: ids, segment lengths and resets
        ids, places = (np.frombuffer(bytes(x), "<u2") for x in (r.input_ids, r.position_ids))
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any() and not places[r.n_tokens :].any()
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert places[a:b].tolist() == list(range(b - a)) and ids[b - 1] == 1
            found.append((str(r.doc_ids[k]), b - a))
    assert sorted(found) == want


def test_key_names_that_clash(spark):
    with pytest.raises(ValueError):
        packing.packed_pieces(spark.createDataFrame([(1, "a")], "Offset long, text string"), PATH, key="Offset")


def test_encoder_forgets_what_it_met_once(monkeypatch):
    """What stays in a worker after a task is bounded, and what it meets again and again is not encoded anew."""
    monkeypatch.setattr(tokens, "_REMEMBERED", 4000)
    known, learnt = tokens.Encoder(PATH), []
    learn = known._learn
    monkeypatch.setattr(known, "_learn", lambda pieces: (learnt.extend(pieces), learn(pieces)))
    for round_ in range(24):
        texts = ["The common words, the Common words! x1 naïve", " ".join(f"q{round_}a{i}z, W{'abcdefghij'[i % 10]}{'klmnopqrst'[round_ % 10]}" for i in range(40)), None, "<|endoftext|> y"]
        ids, at = known.encode(texts, 1)
        if round_ % 8 == 7:
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in texts]
        assert known._held < 5000 and len(known._runs) < 2000
    assert learnt.count("common") == 1 and learnt.count("words!") == 1 and learnt.count("q0a1z,") == 1


def test_workers_drop_what_another_operator_remembers(spark, docs):
    """An idle worker of a later stage holds no tokenizer tables."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._encoders)] * batch.num_rows, pa.int64())], names=["n"])

    assert packing.packed_pieces(docs, PATH).count()
    assert {r.n for r in frames.arrow_map(docs, held, "n long").collect()} == {0}
    frames.begin_task("packing")
    known = tokens.encoder(PATH)
    frames.begin_task("packing")
    assert tokens.encoder(PATH) is known
    frames.begin_task("near_dedup")
    assert not tokens._encoders
