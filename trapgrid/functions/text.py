"""String columns. Missing text stays missing unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piece(text: Column, sep: str, n: int) -> Column:
    """The n-th piece (from 1) of `text` split at `sep`, null if there is none.

    An empty piece at the very end does not count as a piece.
    """
    pieces = count_char(text, sep) + F.when(text.endswith(sep), 0).otherwise(1)
    found = F.substring_index(F.substring_index(text, sep, n), sep, -1)
    return F.when((text != "") & (pieces >= n), found)


def paste(*parts: Column, sep: str = "_") -> Column:
    """Parts joined with `sep`; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def drop_last_char(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.char_length(text) - 1)


def strip_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def last_suffix(text: Column, sep: str = "_") -> Column:
    return F.substring_index(text, sep, -1)


def title_case(text: Column) -> Column:
    """Each word with a capital and the rest small; words end at anything but letters, digits, `_`, `.` and `'`."""
    edge = r"(?<=[^\p{L}\p{N}_.'])|(?=[^\p{L}\p{N}_.'])"
    return F.array_join(F.transform(F.split(text, edge), F.initcap), "")


def count_char(text: Column, char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(char), F.lit("")))


def recode(text: Column, mapping: dict[str, str]) -> Column:
    """Values named in `mapping` replaced, all others kept."""
    out = None
    for old, new in mapping.items():
        out = F.when(text == old, new) if out is None else out.when(text == old, new)
    return text if out is None else out.otherwise(text)
