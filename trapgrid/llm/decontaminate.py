"""Passages of benchmark items in documents, by one Aho-Corasick automaton over normalised text."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapgrid.llm.frames import free_name, with_computed
from trapgrid.llm.textbytes import flat
from trapgrid.session import checkpointed

#: Words: ASCII digits and letters and every byte beyond ASCII; A-Z in lower case, all else a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def _windows(text: str | None, window: int) -> list[bytes]:
    words = _words(text or "")
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


@functools.lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str, str], ...], window: int):
    """The automaton over all windows, each with its number of words and the items that have it."""
    import ahocorasick

    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for passage in _windows(text, window):
            found.setdefault(passage, set()).add(item)
    machine = ahocorasick.Automaton()
    for passage, owners in found.items():
        # One character per byte; the blanks keep a match from starting or ending inside a word.
        machine.add_word(f" {passage.decode('latin-1')} ", (passage.count(b" ") + 1, tuple(sorted(owners))))
    if found:
        machine.make_automaton()
    return machine if found else None


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _character_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where the runs of words stand in the text as it was given, in characters."""
    kept = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    starts = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]))
    ends = np.flatnonzero(kept & ~np.concatenate([kept[1:], [False]])) + 1
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    characters = np.concatenate([[0], np.cumsum(heads)])
    return [(int(characters[starts[a]]), int(characters[ends[b]])) for a, b in runs]


def _scanner(items: tuple[tuple[str, str], ...], window: int, text: str, before: str | None) -> Callable:
    def make():
        machine = _automaton(items, window)

        def compute(rows: pa.RecordBatch) -> pa.Array:
            data, at = flat(rows.column(rows.schema.get_field_index(text)))
            earlier = rows.column(rows.schema.get_field_index(before)).to_pylist() if before else None
            raw, out = data.tobytes(), []
            for i in range(len(at) - 1):
                own = raw[at[i] : at[i + 1]]
                words = own.translate(_NORMAL).split()
                runs, owners = [], set()
                if machine and words:
                    places = None
                    for end, (n, names) in machine.iter(f" {b' '.join(words).decode('latin-1')} "):
                        if places is None:
                            places = np.cumsum([len(w) + 1 for w in words])
                        last = int(np.searchsorted(places, end))
                        runs.append((last - n + 1, last))
                        owners.update(names)
                if earlier:
                    runs += [(r["first"], r["last"]) for r in earlier[i]["runs"]]
                    owners.update(earlier[i]["items"])
                runs = _merged(runs)
                out.append(
                    {
                        "n_words": len(words),
                        "items": sorted(owners),
                        "runs": [{"first": a, "last": b} for a, b in runs],
                        "spans": [{"start": a, "end": b} for a, b in (_character_spans(own, runs) if runs else [])],
                    }
                )
            pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
            kind = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pair("first", "last")), ("spans", pair("start", "end"))])
            return pa.array(out, kind)

        return compute

    return make


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "hits",
    window: int = 13,
    automaton_bytes: int = 1 << 24,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """`docs` with a struct column `name`: n_words, items (ids, as sorted strings, of the items that
    have a window in the text), runs (first and last number of the words inside windows) and spans
    (the same in characters of the text as it was given).

    A window is `window` consecutive words of an item's text, or the whole of a shorter one. All
    windows go into one automaton, which is sent to the tasks; that is done for at most
    `automaton_bytes` bytes of items, which bounds it to some hundred bytes for each of
    them. A larger benchmark is dealt by item into parts of that size, and the documents are scanned once
    for each part, with a checkpoint between. Null or empty text has no words; a null item id is the
    item "null"; an item without words has no window; several rows of an item count as one item.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"{name} is a column of the documents")
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.coalesce(item_text, F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-2 * int(total) // automaton_bytes)) if total > automaton_bytes else 1
    out, before = docs, None
    for part in range(parts):
        # Bounded by the size looked up above.
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else items
        rows = tuple(sorted((r.i, r.t) for r in own.collect()))
        into = name if part == parts - 1 else free_name(out, f"{name}_{part}")
        kept = [c for c in out.columns if c != before]
        out = with_computed(out, into, _HITS, _scanner(rows, window, text, before), text).select(*[F.col(f"`{c}`") for c in kept], into)
        if part < parts - 1:
            out = checkpointed(out)
        before = into
    return out


def is_contaminated(hits: str):
    """Whether a twentieth or more of the words stand in windows of items."""
    n = hit_words(hits)
    return (n > 0) & (20 * n >= F.col(f"{hits}.n_words"))


def hit_words(hits: str):
    return F.aggregate(f"{hits}.runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
