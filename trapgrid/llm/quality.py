"""Quality rules: failing lines go first, then documents that lost too much text. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.frames import free_name

_SPACE = r"[ \t\n\x0B\f\r]+"
_SYMBOLS = r"[#*$%&|<>]"
#: Punctuation that prose has little of, counted in each line.
_MARKS = r"[#*$%&|<>{}\[\]^~=_\\/@+!?]"
_NAVIGATION = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|register|search|contact us|about us|next|previous|back to top|share|tweet|read more)\W*$"
_BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
    r"|(released|licensed) under|is licensed under|click here|subscribe to our)"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in a window of `window` words that occurs twice or more, the first time included.

    Windows are sorted by their hash, so that equal ones are neighbours; nothing is compared in pairs.
    """
    zero = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        # Each window covers up to the next one's start, the last one in full.
        step = lambda p, i: F.when(i + 1 < F.size(places), F.least(places[i + 1] - p, F.lit(window))).otherwise(window)
        return F.aggregate(F.transform(places, step), zero, lambda n, x: n + x)

    def places_of(found: Column) -> Column:
        same = lambda x, i: ((i > 0) & (F.get(found, i - 1)["h"] == x["h"])) | (F.get(found, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(found, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - window),
            lambda i: F.struct(F.xxhash64(*[ws[i + j] for j in range(window)]).alias("h"), i.alias("i")),
        )

    count = _let(words, lambda ws: F.when(F.size(ws) < window, zero).otherwise(_let(F.array_sort(windows(ws)), lambda s: _let(places_of(s), covered))))
    return count.cast("long")


def _removed(text: Column) -> Column:
    """Code points, without white space, of the lines that fail a rule."""

    def fails(line: Column) -> Column:
        solid = F.length(F.regexp_replace(line, _SPACE, ""))
        marks = solid - F.length(F.regexp_replace(F.regexp_replace(line, _SPACE, ""), _MARKS, ""))
        return (
            (10 * marks > 2 * solid)  # punctuation
            | F.rlike(line, F.lit(_NAVIGATION))
            | (F.size(F.split(line, r" [|»·>] ")) > 4)  # a row of links
            | (F.rlike(line, F.lit(_BOILERPLATE)) & (F.length(line) < 200))
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.coalesce(fails(x), F.lit(False)))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(F.regexp_replace(x, _SPACE, "")))


def with_quality(docs: DataFrame, name: str = "quality", most_removed: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` with a struct column `name`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_chars, kept.

    base_failed: under 50 words, or over half of them repeated. Lines fail for much punctuation, as
    navigation (one known word, or a row of links) or as short boilerplate; `kept` is false if base_failed,
    or if failed lines hold more than `most_removed` of the text's characters (white space not counted).
    Null or empty text has no words and is not kept. Other columns and repeated rows stay as they are.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"{name} is a column of the documents")
    body = F.coalesce(F.col(text), F.lit(""))
    zero = F.lit(0).cast("long")

    def facts(words: Column) -> Column:
        filled = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t\n\x0B\f\r]")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, zero, lambda n, w: n + F.length(w)).alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            _removed(body).alias("removed_chars"),
        )

    def verdict(f: Column) -> Column:
        failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
        parts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(
            *[f[p].alias(p) for p in parts],
            failed.alias("base_failed"),
            f["removed_chars"].alias("removed_chars"),
            (~failed & (f["removed_chars"] <= most_removed * f["word_chars"])).alias("kept"),
        )

    return docs.withColumn(name, _let(_let(words_of(body), facts), verdict))


def cleaned_text(text: Column) -> Column:
    """The text without the lines that fail a rule; null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.coalesce(_removed(x) == 0, F.lit(True)) | (x == "")), "\n")


def without_failing_lines(docs: DataFrame, most_removed: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; other columns stay, and texts without such lines too.

    Lines are judged once for the verdict, and once more in texts that lose some.
    """
    name = free_name(docs, "quality")
    kept = with_quality(docs, name, most_removed, text).where(F.col(f"{name}.kept"))
    return kept.withColumn(text, F.when(F.col(f"{name}.removed_chars") > 0, cleaned_text(F.col(text))).otherwise(F.col(text))).drop(name)
