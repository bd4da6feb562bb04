"""Repeated passages, byte for byte: distributed prefix doubling over positions that content picks.

Plain prefix doubling ranks every position of every text in each round. Here the first round ranks
only anchors, and positions drop out of the rounds as soon as they are settled:

1. offset 0: an anchor is the place with the lowest hash among the ANCHOR-byte strings of a window of
   `least` bytes. It depends on the window's bytes alone, so that equal windows have the same anchor. Each
   anchor stands for the windows that chose it, which start one after the other.
2. The stretch that these windows cover is the anchor's context. Anchors are sorted by (rank of the first bytes,
   rank of the context). A context that occurs earlier settles all its windows as repeated; an anchor whose
   bytes have one context settles them as new.
3. The windows of what is left are sorted by rank pairs at half of `least`: (rank of the first half, rank of the
   second half). All but the first of equal pairs are repeated. Equal windows have one anchor name, by which
   the contexts are dealt, so that most pairs are sorted where they are made.

Ranks are 64-bit names, so that no round needs a global numbering.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.frames import arrow_map, stored
from trapgrid.llm.textbytes import Rolling, flat, mix, slices

ANCHOR = 20
#: Starts of windows that are looked at together; bounds memory for a text of any length.
_SEGMENT = 1 << 21
#: Contexts of one name that a task compares at once.
_TOGETHER = 20_000
#: Documents without an id come after all others.
_NO_ID = 1 << 62


def _order(key: Column, text: Column) -> Column:
    """The place of a document in the order that says what is earlier."""
    return F.coalesce(key.cast("long"), F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))


def anchors(data: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, last start, anchor, name of the anchor, name of the context) in runs of places of `data`."""
    n, width = len(data), least - ANCHOR + 1
    fits = at[1:] - at[:-1] >= least
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, at[:-1][fits], 1)
    np.add.at(change, at[1:][fits] - least + 1, -1)
    valid = np.cumsum(change[:n], dtype=np.int8).astype(bool)
    for begin in range(0, n, _SEGMENT):
        # A window's anchor may be the anchor of windows up to `width` before and after it.
        low, high = max(0, begin - width), min(n, begin + _SEGMENT + width + least)
        starts = np.flatnonzero(valid[low : max(low, high - least + 1)])
        if not len(starts):
            continue
        rolling = Rolling(data[low:high])
        names = rolling.every(ANCHOR)
        best = (names >> np.uint64(24) << np.uint64(24)) | np.arange(len(names), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < width:
            best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
        place = (best[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first, last, place = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])], place[new]
        own = (place + low >= begin) & (place + low < begin + _SEGMENT)
        first, last, place = first[own], last[own], place[own]
        context = rolling.stretch(first, last + least) ^ mix((place - first).astype(np.uint64))
        yield first + low, last + low, place + low, names[place], context


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of documents, with those that touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Documents are set apart, so that one running maximum serves all of them.
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * wide)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + group[1:] * wide > reach[:-1]]))
    return doc[new], start[new], (reach - group * wide)[np.concatenate([new[1:] - 1, [len(doc) - 1]])]


def _first_round(least: int, text: str) -> Callable:
    """Anchors of all texts, and the stretches that repeat an earlier context of the same batch.

    Rows are kept narrow, as most of them go through the exchange only to be found alone: doc; at, which
    is start * 256 + 2 * (windows - 1) for an anchor and start * 256 + 1 for a stretch; name; context, for a stretch
    its end. A stretch is settled already, and its name only spreads the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows in slices(batch, text):
                data, at = flat(rows.column(rows.schema.get_field_index(text)))
                ids = rows.column(rows.schema.get_field_index("doc")).to_numpy()
                for first, last, place, name, context in anchors(data, at, least):
                    of = np.searchsorted(at, first, "right") - 1
                    found.append((ids[of], first - at[of], last - first, place - first, name, context))
            if not found:
                continue
            doc, start, more, _, name, context = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, context))
            doc, start, more, name, context = (x[order] for x in (doc, start, more, name, context))
            head = np.concatenate([[True], context[1:] != context[:-1]])
            to = np.flatnonzero(head)[np.cumsum(head) - 1]
            again = (doc > doc[to]) | (start > start[to])
            rest = ~again
            yield _row_batch(doc[rest], (start[rest] << 8) | (more[rest] << 1), name[rest], context[rest])
            doc, start, end = _merged(doc[again], start[again], start[again] + more[again] + least)
            yield _row_batch(doc, (start << 8) | 1, mix(mix(doc.astype(np.uint64)) + start.astype(np.uint64)), end.astype(np.uint64))

    return run


def _row_batch(doc: np.ndarray, at: np.ndarray, name: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(doc), pa.array(at), pa.array(name.view(np.int64)), pa.array(context.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "at", "name", "context"])


def _contexts(least: int, text: str) -> Callable:
    """The bytes of the contexts that the second round left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                raw, at = flat(rows.column(rows.schema.get_field_index(text)))
                raw = raw.tobytes()
                docs, out = rows.column(rows.schema.get_field_index("doc")).to_pylist(), []
                for doc, base, wanted in zip(docs, at.tolist(), rows.column(rows.schema.get_field_index("open")).to_pylist()):
                    out += [(x["name"], doc, x["start"], raw[base + x["start"] : base + x["start"] + x["more"] + least]) for x in wanted]
                names = ["name", "doc", "start", "bytes"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return run


def _windows(held: list[pa.RecordBatch], least: int) -> tuple[np.ndarray, ...]:
    """(doc, start, first half, second half) of all windows in the contexts, sorted by rank pair, then place; and which
    of them repeat the first of their pair."""
    table = pa.Table.from_batches(held).combine_chunks()
    rolling, at = _rolled(table["bytes"].chunk(0))
    count = np.diff(at) - least + 1
    of = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    here, half = at[of] + step, least // 2
    first, second = rolling.stretch(here, here + half), rolling.stretch(here + half, here + least)
    doc, start = table["doc"].to_numpy()[of], table["start"].to_numpy()[of] + step
    order = np.lexsort((start, doc, second, first))
    doc, start, first, second = doc[order], start[order], first[order], second[order]
    head = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    to = np.flatnonzero(head)[np.cumsum(head) - 1]
    return doc, start, first, second, (doc > doc[to]) | (start > start[to])


def _rolled(column: pa.Array) -> tuple[Rolling, np.ndarray]:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return Rolling(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]), at - at[0]


def _pairs(least: int) -> Callable:
    """Rank pairs of the windows in contexts that come sorted by name.

    Equal windows have one name, so a name's contexts settle each other: what repeats an earlier
    window comes out as stretches. Only of names with more than _TOGETHER contexts are the
    pairs themselves given out, to be sorted by Spark.
    """

    def settle(held: list[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "first", "second", "end"]
        doc, start, first, second, again = _windows(held, least)
        ends = _merged(doc[again], start[again], start[again] + least)
        n = len(ends[0])
        yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(ends[2])], names=names)
        if not whole:
            rest = ~again
            columns = [pa.array(x[rest].view(np.int64)) for x in (doc, start, first, second)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(rest.sum()), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None
        for batch in batches:
            names = batch.column(0).to_numpy()
            cut = 0
            if large is not None:  # the rest of a name that is given out as pairs
                cut = int(np.searchsorted(names != large, True)) if names[-1] != large else len(names)
                if cut:
                    yield from settle([batch.slice(0, cut)], False)
                if cut == len(names):
                    continue
                large = None
            last = len(names) - int(np.searchsorted(names[::-1] != names[-1], True)) if names[cut] != names[-1] else cut
            if last > cut:  # all names but the last are complete
                yield from settle([*held, batch.slice(cut, last - cut)], True)
                held = []
            elif held and held[-1].column(0)[0].as_py() != int(names[cut]):
                yield from settle(held, True)
                held = []
            held.append(batch.slice(last))
            if sum(x.num_rows for x in held) > _TOGETHER:
                large = int(names[-1])
                yield from settle(held, False)
                held = []
        if held:
            yield from settle(held, True)

    return run


def _cut(text: str) -> Callable:
    """What is left of each text, from the stretches to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                data, at = flat(rows.column(rows.schema.get_field_index(text)))
                raw, out = data.tobytes(), []
                for a, b, spans in zip(at.tolist(), at[1:].tolist(), rows.column(rows.schema.get_field_index("spans")).to_pylist()):
                    own, kept, done, runs = raw[a:b], [], 0, []
                    for x in sorted((s["start"], s["end"]) for s in spans or []):
                        start, end = max(x[0], done), min(x[1], len(own))
                        if end <= start:
                            continue
                        kept.append(own[done:start])
                        if runs and runs[-1][1] == start:
                            runs[-1] = (runs[-1][0], end)
                        else:
                            runs.append((start, end))
                        done = end
                    kept.append(own[done:])
                    left = b"".join(kept)
                    out.append((len(own), len(own) - len(left), [{"start": s, "end": e} for s, e in runs], left))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(rows.schema.get_field_index("key")),
                        pa.array([x[0] for x in out], pa.int64()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([x[3] for x in out], pa.binary()),
                    ],
                    names=["key", "n_bytes", "n_removed", "removed", "kept"],
                )

    return run


def repeated_spans(docs: DataFrame, least: int) -> DataFrame:
    """(doc, start, end) in bytes: stretches of `docs` (doc, text) made of strings of `least` bytes that start earlier too."""
    dealt = arrow_map(docs, _first_round(least, "text"), "doc long, at long, name long, context long")
    ranked = dealt.selectExpr(
        "doc", "at", "name", "context",
        "min(struct(doc, at)) over (partition by name, context) as head",
        "min(context) over (partition by name) <> max(context) over (partition by name) as several",
    )
    start, stretch = F.shiftright("at", 8), F.col("at").bitwiseAND(F.lit(1)) == 1
    more = F.shiftright("at", 1).bitwiseAND(F.lit(127))
    repeated = F.struct("doc", "at") > F.col("head")
    kept = ranked.where(stretch | repeated | F.col("several"))
    settled = F.when(stretch, F.col("context")).when(repeated, start + more + least)
    round2 = stored(kept.select("doc", start.alias("start"), settled.alias("end"), "name", more.alias("more")), "suffix-contexts")
    spans = round2.where(F.col("end").isNotNull()).select("doc", "start", "end")

    open_ = round2.where(F.col("end").isNull()).groupBy("doc").agg(F.collect_list(F.struct("name", "start", "more")).alias("open"))
    held = arrow_map(docs.join(open_, "doc"), _contexts(least, "text"), "name long, doc long, start long, bytes binary")
    pairs = arrow_map(held.repartition("name").sortWithinPartitions("name"), _pairs(least), "doc long, start long, first long, second long, end long")
    pairs = stored(pairs, "suffix-pairs")
    ranked = pairs.where(F.col("end").isNull()).selectExpr("doc", "start", "min(struct(doc, start)) over (partition by first, second) as head")
    last = ranked.where(F.struct("doc", "start") > F.col("head")).select("doc", "start", (F.col("start") + least).alias("end"))
    return spans.union(pairs.where(F.col("end").isNotNull()).select("doc", "start", "end")).union(last)


def without_repeats(docs: DataFrame, least: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(`key`, n_bytes, n_removed, removed, kept) for each row of `docs`.

    Texts are taken as UTF-8 bytes, null as empty. Every byte goes that lies in a string of `least` bytes which also
    starts earlier: in a document with a smaller key, or earlier in the same one. All strings are judged
    on the texts as given; none crosses from one document to the next. removed are the maximal runs
    (start, end) in bytes, kept the remaining bytes. Documents without a key come last, in the order of a hash
    of their text. Rows with one key are one document: a repeated row gets the same result and is no
    earlier place; rows with one key and different texts lose what repeats in any of them. Keys are integers below 2**62.
    """
    if not 2 * ANCHOR <= least < 128 + ANCHOR or least % 2:
        raise ValueError(f"least must be an even number from {2 * ANCHOR} to {127 + ANCHOR}")
    body = F.coalesce(F.col(text), F.lit(""))
    ordered = docs.select(_order(F.col(key), body).alias("doc"), F.col(key).alias("key"), body.alias("text"))
    spans = repeated_spans(ordered.where(F.octet_length("text") >= least).select("doc", "text"), least)
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(ordered.join(listed, "doc", "left"), _cut("text"), f"key {kind}, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("key", key) if key != "key" else out
