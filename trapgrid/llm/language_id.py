"""Language of whole texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.llm.frames import free_name, arrow_map, with_computed
from trapgrid.llm.textbytes import mix, slices

UNKNOWN = "und"
_PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def _letter(point: int) -> int:
    c = chr(point)
    return (ord(c.lower()) if len(c.lower()) == 1 else point) if c.isalpha() else 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point of the first plane itself in lower case if it is a letter, else a blank."""
    return np.array([_letter(point) for point in range(1 << 16)], np.uint32)


def _lower(points: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(points, 0xFFFF)]
    for point in np.unique(points[points > 0xFFFF]).tolist():
        out[points == point] = _letter(point)
    return out


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, offsets): letters in lower case, runs of anything else as one blank, a blank at both ends."""
    joined = " ".join(["", *[t or "" for t in texts], ""])
    points = _lower(np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4"))
    at = np.concatenate([[1], 1 + np.cumsum([len(t or "") + 1 for t in texts])])
    blank = points == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[at - 1] = True  # one blank between texts, which both of them use
    places = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], places[at - 1]


def _buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for each n."""
    for n in sizes:
        h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + points[j : j + len(h)]
        yield (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _texts(rows: pa.RecordBatch, column: str) -> list[str | None]:
    return rows.column(rows.schema.get_field_index(column)).to_pylist()


def ngram_counts(rows: DataFrame, sizes: tuple[int, ...], bits: int, max_languages: int, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): how often each bucket occurs in the texts of a language.

    Each task adds up its own rows first and gives at most languages * buckets rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                points, at = _characters(_texts(part, text))
                names = _texts(part, lang)
                index = {x: i for i, x in enumerate(dict.fromkeys(names))}
                of = np.repeat([index[x] for x in names], np.diff(at))
                counts = np.zeros((len(index), 1 << bits), np.int64)
                for n, b in zip(sizes, _buckets(points, sizes, bits)):
                    own = np.flatnonzero(np.arange(min(len(of), len(b))) <= np.repeat(at[1:] - n + 1, np.diff(at))[: len(b)])
                    counts += np.bincount((of[own] << bits) + b[own], minlength=counts.size).reshape(counts.shape)
                for x, i in index.items():
                    sums[x] = counts[i] + sums[x] if x in sums else counts[i]
                if len(sums) > max_languages:
                    raise ValueError(f"more than {max_languages} languages")
        for x, counts in sums.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(full), pa.string()), pa.array(full), pa.array(counts[full])], names=["lang", "bucket", "n"])

    known = rows.where(F.col(lang).isNotNull()).select(F.coalesce(text, F.lit("")).alias(text), lang)
    parts = arrow_map(known, run, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(
    rows: DataFrame,
    sizes: tuple[int, ...] = (1, 2, 3),
    bits: int = 15,
    smoothing: float = 0.5,
    max_languages: int = 256,
    text: str = "text",
    lang: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of each bucket for each language) from all rows with a language.

    The matrix has at most `max_languages` * 2**`bits` numbers; more languages are an error. No
    rows give no languages. All languages count as equally likely beforehand.
    """
    counts = ngram_counts(rows, sizes, bits, max_languages, text, lang).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    index = {x: i for i, x in enumerate(names)}
    matrix = np.full((1 << bits, len(names)), smoothing)
    matrix[counts["bucket"].to_numpy(), [index[x] for x in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    return names, np.log(matrix / matrix.sum(0)).astype(np.float32) if names else matrix.astype(np.float32)


def _classifier(names: list[str], held, sizes: tuple[int, ...], bits: int, text: str) -> Callable:
    def make():
        matrix = held.value

        def compute(rows: pa.RecordBatch) -> pa.Array:
            texts = _texts(rows, text)
            points, at = _characters(texts)
            sums, letters = np.zeros((len(texts), len(names))), np.concatenate([[0], np.cumsum(points != 32)])
            for n, b in zip(sizes, _buckets(points, sizes, bits)):
                for k in range(len(names)):
                    before = np.concatenate([[0.0], np.cumsum(matrix[:, k][b], dtype=np.float64)])
                    last = np.minimum(np.maximum(at[1:] - n + 2, at[:-1]), len(b))
                    first = np.minimum(at[:-1], len(b))
                    sums[:, k] += before[np.maximum(last, first)] - before[first]
            spoken = letters[at[1:]] > letters[at[:-1]]
            if names:
                best = sums.argmax(1)
                shares = np.exp(sums - sums.max(1, keepdims=True))
                score = np.where(spoken, 1.0 / shares.sum(1), 0.0)
                found = [names[k] if s else UNKNOWN for k, s in zip(best, spoken)]
            else:
                score, found = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score)], names=["lang", "score"])

        return compute

    return make


def with_language(
    docs: DataFrame,
    labelled: DataFrame,
    name: str = "language",
    sizes: tuple[int, ...] = (1, 2, 3),
    bits: int = 15,
    smoothing: float = 0.5,
    max_languages: int = 256,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """`docs` with a struct column `name`: lang (the likeliest language of the labelled rows) and
    score (its probability, from 0 to 1).

    Whole texts are scored: letters in lower case, anything else a blank. Null text, or text without a letter, is
    "und" with score 0; so is everything if no row is labelled. Equally likely languages: the first by name. The matrix
    of log probabilities, bounded by `max_languages` and `bits`, is broadcast; a task scores a few MB of text at a time.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"{name} is a column of the documents")
    names, matrix = train(labelled, sizes, bits, smoothing, max_languages, text, lang)
    held = docs.sparkSession.sparkContext.broadcast(matrix)
    return with_computed(docs, name, _PREDICTION, _classifier(names, held, sizes, bits, text), text)
