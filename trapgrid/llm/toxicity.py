"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then word evidence.

Disguised words (digits and signs for letters, letters set apart, letters repeated) are decoded by Viterbi
over the lattice of what each sign may stand for, under a character trigram model of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.llm.frames import arrow_map, free_name, stored, with_computed
from trapgrid.llm.textbytes import slices

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Letters the character model tells apart; all others are one.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýßÿ"
_APART = " .-_*~,;:/\\'\""
_AROUND = ".,;:?\"'()[]{}<>#%&*~^=/\\-_|`!$+@"
#: Signs that may hide any letter.
_MASKS = "*"
_KNOWN = frozenset(_LETTERS) | {"", " "}
_DOUBLED = re.compile(r"(.)\1").search
_OTHER = re.compile(f"[^{_LETTERS}]").sub
#: Tokens that a task remembers before it starts afresh.
_REMEMBERED = 1 << 20
#: Pieces of evidence that are sent to the tasks as they are.
_SENT = 1 << 18
#: Minwise values in a key, and the hash functions of eight keys.
_BAND = 4
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 8 * _BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class CharacterModel:
    """Interpolated trigram model over letters; a blank stands on both sides of a word."""

    def __init__(self, trigrams: dict[str, int]):
        self._three = trigrams
        self._two: Counter[str] = Counter()
        self._one: Counter[str] = Counter()
        self._pairs: Counter[str] = Counter()
        for gram, n in trigrams.items():
            self._pairs[gram[:2]] += n
            self._two[gram[1:]] += n
            self._one[gram[2]] += n
        self._starts: Counter[str] = Counter()
        for gram, n in self._two.items():
            self._starts[gram[0]] += n
        self._all = sum(self._one.values())
        self.seen: dict[str, float] = {}

    def log_p(self, before: str, c: str) -> float:
        c = c if c == " " or c in _LETTERS else "~"
        gram = before + c
        if gram not in self.seen:
            one = (self._one[c] + 1) / (self._all + len(_LETTERS) + 2)
            two = (self._two[gram[1:]] + 4 * one) / (self._starts[gram[1]] + 4)
            self.seen[gram] = math.log((self._three.get(gram, 0) + 4 * two) / (self._pairs[before] + 4))
        return self.seen[gram]


@lru_cache(1 << 12)
def _letter(c: str, again: bool, short: bool) -> list[tuple[str, str, float]]:
    """Choices of a letter, which may be left out where it repeats; `short` runs of it are likelier meant."""
    out = [(c, 0.0 if short or not again else 2.0)] + ([("", 3.0 if short else 0.3)] if again else [])
    return [(x, x if x in _KNOWN else "~", cost) for x, cost in out]


def _lattice(token: str) -> Iterator[list[tuple[str, str, float]]]:
    """For each sign of a token what it may stand for (as text, as the model sees it) and the cost of that in the channel.

    Blanks stand between letters set apart: each may be a break between words or nothing, and letters repeat across them.
    """
    runs = [len(list(same)) for _, same in groupby(token.replace(" ", ""))]
    places = iter([(i, n) for n in runs for i in range(n)])
    for c in token:
        i, whole = next(places) if c != " " else (0, 1)
        if c.isalpha():
            yield _letter(c, i > 0, whole < 3)
            continue
        if c in SIGNS:
            out = [(x, 1.0) for x in SIGNS[c]] + [("", 6.0 if not i else 1.0), (" ", 5.0)]
        elif c in _APART:
            out = [("", 1.0), (" ", 2.5)]
            if c in _MASKS and whole < 3:  # a letter left out; three and more in a row are a rule
                out += [(x, 2.0) for x in _LETTERS[:26]]
        else:
            out = [("", 4.0), (" ", 2.0)]
        yield [(x, x if x in _KNOWN else "~", cost) for x, cost in out]


def decode(token: str, model: CharacterModel) -> str:
    """The likeliest plain text behind a token of any length: best path through its lattice; the state is the last two characters.

    A path is a chain of (path before, character), so that the work is in proportion to the length.
    """
    known = model.seen.get
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for choices in chain(_lattice(token), [[(" ", " ", 0.0)]]):
        if len(best) == 1 and len(choices) == 1 and choices[0][0] not in " ":  # one path goes one way; what that costs decides nothing
            (state, (score, path)), (c, seen, _) = *best.items(), choices[0]
            best = {state[1] + seen: (score, (path, c))}
            continue
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            last = state[1]
            for c, seen, cost in choices:
                if not c or (c == " " and last == " "):
                    now, key, told = score - cost, state, path
                else:
                    p = known(state + seen)
                    now, key, told = score - cost + (model.log_p(state, seen) if p is None else p), last + seen, (path, c)
                other = after.get(key)
                if other is None or now > other[0]:
                    after[key] = (now, told)
        best = after
    path, out = max(best.items(), key=lambda x: (x[1][0], x[0]))[1][1], []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


class _Memory(dict):
    """What a function of a text gave, looked up where it is asked again; starts afresh when it holds too many."""

    def __init__(self, make: Callable):
        super().__init__()
        self._make = make

    def __missing__(self, token: str):
        got = self._make(token)
        if len(self) > _REMEMBERED:
            self.clear()
        self[token] = got
        return got


class Restorer:
    """Distinct plain words of texts; remembers the tokens it has decoded."""

    def __init__(self, model: CharacterModel):
        self._model = model
        self._words = _Memory(self._restore)
        self._runs = _Memory(lambda letters: tuple(decode(letters, self._model).split()))

    def _restore(self, token: str) -> tuple[str, ...]:
        core = token.strip(_AROUND)
        if core.isalpha() and not _DOUBLED(core):
            return (core,)
        # Signs at the ends may be letters too, where something of the token is a letter.
        core = token.strip(".,;:?\"'()[]{}<>#%&*~^=/\\-_`").rstrip("!")
        if not any(c.isalpha() for c in core):
            return ()
        parts = [p for p in "".join(c if c.isalnum() or c in SIGNS else " " for c in core).split()]
        whole = decode(core, self._model).split()
        if len(parts) > 1 and max(map(len, parts)) > 1:  # words with a sign between them, or one with a sign in it: both readings
            whole += [w for p in parts for w in self._words[p]]
        return tuple(whole)

    def words(self, text: str | None) -> set[str]:
        tokens = (text or "").lower().split()
        out: set[str] = set()
        out.update(*map(self._words.__getitem__, set(tokens)))
        sizes = list(map(len, tokens))
        single = [i for i, n in enumerate(sizes) if n == 1] if 1 in sizes else []
        first = 0
        for k in range(1, len(single) + 1):
            if k == len(single) or single[k] != single[k - 1] + 1:
                if k - first > 1:  # letters set apart
                    out.update(self._runs[" ".join(tokens[single[first] : single[k - 1] + 1])])
                first = k
        return out


def evidence_of(word: str) -> list[str]:
    """What stands for a word: the word itself and its beginnings of 4 to 7 letters."""
    return [word, *[word[:n] + "-" for n in range(4, min(8, len(word)))]]


def _column(rows: pa.RecordBatch, name: str) -> list:
    return rows.column(rows.schema.get_field_index(name)).to_pylist()


def character_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Trigram counts of the words of the whole corpus, summed up in the tasks; what they send on and what comes to
    the driver is bounded by the cube of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for rows in slices(batch, text):
                for t in _column(rows, text):
                    found.update((t or "").lower().split())
            grams: dict[str, int] = defaultdict(int)
            for token, n in found.items():
                core = token.strip(_AROUND)
                if core.isalpha():
                    plain = f"  {core if core.isascii() else _OTHER('~', core)} "
                    for i in range(len(plain) - 2):
                        grams[plain[i : i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    grams = arrow_map(docs.select(text), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in grams.collect()}


def labelled_texts(docs: DataFrame, marks: DataFrame, most_labelled: int = 200_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, label, `text`) of the documents that `marks` (`key`, label; one row per key) labels.

    Of more than `most_labelled` marks about that many are used, picked by a hash of the key: a bound on the fit alone.
    It keeps the list small enough to broadcast, so that no text is shuffled to find its label. Marks without a document are
    left out; repeated documents are all used.
    """
    n = marks.count()
    if n > most_labelled:
        marks = marks.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < 1_000_000 * most_labelled / n)
    return docs.join(F.broadcast(marks), key).select(F.col(key).alias("doc"), "label", text)


def _restored(rows: DataFrame, trigrams: dict[str, int], text: str) -> DataFrame:
    """`rows` with `words`, the distinct restored words as one text, `near`, a hash of them, `keys`, of which near copies share
    some (each a hash of _BAND minwise values of the words), and `low`, a byte of each minwise value."""
    held = rows.sparkSession.sparkContext.broadcast(trigrams)
    kind = T.StructType(
        [T.StructField("words", T.StringType()), T.StructField("near", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType())]
    )

    def make() -> Callable:
        restorer = Restorer(CharacterModel(held.value))

        def compute(part: pa.RecordBatch) -> pa.Array:
            words, near, keys, lows = [], [], [], []
            for t in _column(part, text):
                found = sorted(restorer.words(t))
                words.append(" ".join(found))
                near.append(_name(words[-1]))
                low = _minwise(found)
                keys.append([_name(f"{i} {band.tobytes().hex()}") for i, band in enumerate(low.reshape(-1, _BAND))] if found else [])
                lows.append((low & np.uint64(255)).astype(np.uint8).tobytes())
            columns = [pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())]
            return pa.StructArray.from_arrays(columns, names=[f.name for f in kind])

        return compute

    made = with_computed(rows, "restored", kind, make, text).select(*[c for c in rows.columns if c != text], "restored.*")
    return made.withColumn("row", F.monotonically_increasing_id())


def _name(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def _minwise(words: list[str]) -> np.ndarray:
    """The smallest value of each of the hash functions over the words."""
    names = np.array([_name(w) for w in words], np.uint64)
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(names), 1024):
        low = np.minimum(low, (names[None, first : first + 1024] * _MULTIPLIERS[:, None]).min(1))
    return low


def _once(rows: DataFrame) -> DataFrame:
    """(row) of the rows that count, near copies once. `rows` is stored.

    Of rows with equal sets of words and one label the first counts. Of the rest, a row goes if the one with the lowest hash of those it
    shares a key with shares three quarters of the words of both. Only pairs whose minwise values agree in half
    of the places (a pair at three quarters agrees in less with a probability of 0.001) are confirmed, on 64-bit hashes
    of the words; no other set is moved.
    """
    own = rows.groupBy("label", "near").agg(F.min("row").alias("row"))
    firsts = rows.join(F.broadcast(stored(own.select("row"), "toxic-first")), "row", "left_semi")
    keys = firsts.select("label", "near", "low", "row", F.explode("keys").alias("k"))
    heads = keys.groupBy("label", "k").agg(F.min(F.struct("near", "low", "row")).alias("head"), F.count("*").alias("n")).where("n > 1")
    agree = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(_MULTIPLIERS))), lambda i: F.substring("low", i, F.lit(1)) == F.substring("head.low", i, F.lit(1))))
    pairs = keys.join(heads, ["label", "k"]).where((F.col("near") != F.col("head.near")) & (2 * agree >= len(_MULTIPLIERS)))
    pairs = stored(pairs.select("row", F.col("head.row").alias("head")).distinct(), "toxic-pairs")
    wanted = stored(pairs.select("row").union(pairs.select("head")).distinct(), "toxic-wanted")
    names = F.array_distinct(F.transform(F.split("words", " "), lambda w: F.xxhash64(w)))
    sets = rows.join(F.broadcast(wanted), "row", "left_semi").select("row", names.alias("set"))
    both = pairs.join(sets.select(F.col("row").alias("head"), F.col("set").alias("other")), "head").join(sets, "row")
    shared = F.size(F.array_intersect("set", "other"))
    copies = both.where(4 * shared >= 3 * (F.size("set") + F.size("other") - shared)).select("row").distinct()
    return stored(firsts.select("row").join(F.broadcast(stored(copies, "toxic-copies")), "row", "left_anti"), "toxic-once")


def train(
    labelled: DataFrame, trigrams: dict[str, int], least_docs: int = 6, least_gain: float = 12.0, text: str = "text"
) -> tuple[DataFrame, tuple[float, float]]:
    """((piece, weight) of the evidence, (intercept, slope) of the score) from (doc, label, `text`) rows, a bounded list as of labelled_texts.

    Near copies with the same label count once (see _once); every other labelled text stays.
    Three of four of these give the evidence: pieces in at least `least_docs` toxic documents, most of them toxic,
    with a likelihood gain over the share of toxic documents of `least_gain`. The fourth sets the score.
    """
    rows = stored(_restored(labelled, trigrams, text), "toxic-words")
    # Row numbers of a bounded list of texts, so that no words are moved to find them.
    once = rows.join(F.broadcast(_once(rows)), "row", "left_semi").select("label", "words", "near")
    fourth = F.pmod(F.xxhash64("near"), F.lit(4)) == 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = _Memory(evidence_of)
        for batch in batches:
            found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for words, label in zip(_column(batch, "words"), _column(batch, "label")):
                found[label].update(set().union(*map(pieces_of.__getitem__, words.split())))
            pieces = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.string()), pa.array([found[0][p] for p in pieces], pa.int64()), pa.array([found[1][p] for p in pieces], pa.int64())], names=["piece", "clean", "toxic"]
            )

    totals = {r.label: r["count"] for r in once.where(~fourth).groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return rows.sparkSession.createDataFrame([], "piece string, weight double"), (-3.0, 0.0)
    base = totals[1] / (totals[0] + totals[1])
    counts = arrow_map(once.where(~fourth).select("words", "label"), count, "piece string, clean long, toxic long")
    counts = counts.groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least_docs)
    share = (F.col("toxic") + 4 * base) / (F.col("toxic") + F.col("clean") + 4)
    gain = F.col("toxic") * F.log(share / base)
    rated = counts.select("piece", F.log(share / (1 - share)).alias("weight"), share.alias("share"), gain.alias("gain"))
    weights = stored(rated.where((F.col("share") > 0.5) & (F.col("gain") >= least_gain)).select("piece", "weight"), "toxic-evidence")
    sums = _summed(once.where(fourth).select("label", "words"), weights, "words", split=True)
    # Steps of a tenth, and beyond fifty of two digits: a few hundred bins, whatever the longest text holds.
    digits = F.pow(F.lit(10.0), F.floor(F.log10("evidence")) - 1)
    step = F.when(F.col("evidence") <= 50, F.round("evidence", 1)).otherwise(F.round(F.col("evidence") / digits) * digits)
    bins = sums.groupBy("label", step.alias("x")).count().collect()
    return weights, _logistic([(r.x, r.label, r["count"]) for r in bins], base)


def _logistic(points: list[tuple[float, int, int]], base: float) -> tuple[float, float]:
    """Intercept and slope by Newton's steps with a weak prior; points are (x, label, count), some hundred at most."""
    b = np.array([math.log(base / (1 - base)), 0.5])
    prior = np.array([b[0] - 1.0, 1.0])
    x = np.array([[1.0, p[0]] for p in points]).reshape(-1, 2)
    y, n = np.array([float(p[1]) for p in points]), np.array([float(p[2]) for p in points])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (n * (y - p)) - (b - prior)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2)
        b = b + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(b[0]), float(max(b[1], 0.0))


def _summed(rows: DataFrame, weights: DataFrame, text: str, trigrams: dict[str, int] | None = None, split: bool = False, name: str = "evidence") -> DataFrame:
    """`rows` with `name`: the summed weights of the distinct words, each by its strongest evidence.

    `split` says that `text` has restored words. Evidence of up to _SENT pieces is sent to the tasks; more is joined.
    """
    spark = rows.sparkSession
    grams = spark.sparkContext.broadcast(trigrams or {})

    def words_of() -> Callable[[str | None], set[str]]:
        return (lambda t: set((t or "").split())) if split else Restorer(CharacterModel(grams.value)).words

    if weights.count() > _SENT:
        return _joined(rows, weights, text, words_of, name)
    held = spark.sparkContext.broadcast({r.piece: r.weight for r in weights.collect()})

    def make() -> Callable:
        known, words = held.value, words_of()
        stems = {e[:4] for e in known}  # all pieces of a word begin as it does
        weight = _Memory(lambda word: max([known.get(e, 0.0) for e in evidence_of(word)]) if word[:4] in stems else 0.0)

        def compute(part: pa.RecordBatch) -> pa.Array:
            return pa.array([math.fsum(map(weight.__getitem__, words(t))) for t in _column(part, text)], pa.float64())

        return compute

    return with_computed(rows, name, T.DoubleType(), make, text)


def _joined(rows: DataFrame, weights: DataFrame, text: str, words_of: Callable, name: str) -> DataFrame:
    """The same by a join of the pieces of all words with the evidence, for evidence of any size."""
    own = free_name(rows, "row_number")
    kept = stored(rows.withColumn(own, F.monotonically_increasing_id()), "toxic-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of()
        for batch in batches:
            for part in slices(batch, text):
                found = [(r, w, e) for r, t in zip(_column(part, own), _column(part, text)) for w in words(t) for e in evidence_of(w)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], names=["row", "word", "piece"])

    pieces = arrow_map(kept.select(own, text), run, "row long, word string, piece string").join(weights, "piece")
    strongest = pieces.groupBy("row", "word").agg(F.max(F.greatest("weight", F.lit(0.0))).alias("weight"))
    sums = strongest.groupBy(F.col("row").alias(own)).agg(F.sum("weight").alias(name))
    return kept.join(sums, own, "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop(own)


def with_toxicity(docs: DataFrame, labelled: DataFrame, corpus: DataFrame, name: str = "toxicity", text: str = "text") -> DataFrame:
    """`docs` with a column `name`, the probability from 0 to 1 that the text is toxic.

    `corpus` (`text`) teaches the character model, `labelled` (doc, label 0 or 1, `text`) the evidence. Whole texts
    are scored, disguises of any length decoded. Null or empty text has no evidence and gets the intercept's score, as does every
    text if one of the labels does not occur. Repeated rows are scored alike.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"{name} is a column of the documents")
    trigrams = character_counts(corpus, text)
    weights, (intercept, slope) = train(labelled, trigrams, text=text)
    rated = _summed(docs, weights, text, trigrams, name=name)
    score = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col(name))))
    return rated.withColumn(name, score)
