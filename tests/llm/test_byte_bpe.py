"""Byte-level BPE against the tokenizer library, and exact round trips."""

from __future__ import annotations

import base64
import random

import pytest

from tests.llm import brute
from trapgrid.llm import byte_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return byte_bpe.Codec(byte_bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


TEXTS = ["Don't stop  ", "naïve café x", "a\x1cb \x85c", "<|endoftext|> y", "中文字符 ＡＢ", "🙂🙂 x🙂", "w" * 300, None, "", "x y" * 700, brute.prose(1, 3000), " \n\n\t 12345 ab", " 　a"]


def test_texts(library, codec):
    rng = random.Random(4)
    signs = ["a", "b", "é", "中", " ", "\n", "1", "'s", "$", "🙂", "the", "ing"]
    texts = [*TEXTS, *["".join(rng.choices(signs, k=rng.randint(0, 200))) for _ in range(300)], "ab" * 4000, "".join(rng.choices("abcd", k=5000))]
    ids, at = codec.encode(texts)
    data, ends = codec.decode(ids, at)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(text or "")
        assert data[ends[i] : ends[i + 1]].tobytes() == (text or "").encode()


def test_merges_of_one_and_of_many_pieces_agree(codec):
    rng = random.Random(5)
    words = list({"".join(rng.choices("abcdeé ", k=rng.randint(1, 60))).encode()[:64] for _ in range(300)})
    for word in words:
        word = word.decode(errors="ignore")
        fresh = byte_bpe.Codec(codec._ranks, r"(?s).+")
        assert fresh.encode([word])[0].tolist() == byte_bpe.merge(word.encode(), codec._ranks)


def test_leftmost_of_equal_pairs_merges_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aab": 257, b"ab": 258}
    assert byte_bpe.merge(b"aaaab", ranks) == [256, 257]
    assert byte_bpe.merge(b"aaab", ranks) == [256, 258]
    assert byte_bpe.Codec(ranks, ".+").encode(["aaaab", "aaab"])[0].tolist() == [256, 257, 256, 258]


def test_worker_that_forgets(library, codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 2000)
    for text in (brute.prose(k, 200) for k in range(5)):
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_tables(spark, library):
    rows = [(i if i != 3 else None, t, "extra", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, offset string, pieces int").repartition(2)
    encoded = byte_bpe.with_token_ids(docs, PATH, public_tokenizers.PATTERN)
    assert encoded.columns == [*docs.columns, "ids"]
    got = byte_bpe.with_decoded(encoded, PATH).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.with_decoded(byte_bpe.with_token_ids(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0
    with pytest.raises(ValueError, match="column"):
        byte_bpe.with_token_ids(docs, PATH, public_tokenizers.PATTERN, "TEXT")


def test_ids_that_stand_for_nothing(spark):
    table = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [])], "k long, ids array<int>")
    assert [None if r.decoded is None else len(r.decoded) for r in byte_bpe.with_decoded(table, PATH).orderBy("k").collect()] == [2, None, 0]
    for bad in ([70000], [-1], [None]):
        with pytest.raises(Exception, match="id"):
            byte_bpe.with_decoded(spark.createDataFrame([(bad,)], "ids array<int>"), PATH).collect()
