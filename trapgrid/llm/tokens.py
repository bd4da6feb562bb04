"""Token ids of whole texts by a public tokenizer file, with pieces of text remembered by each worker."""

from __future__ import annotations

import os
from itertools import chain, compress

import numpy as np
import pyarrow as pa

from trapgrid.llm.frames import worker_table

#: White space for Python that the tokenizer's pattern does not split at.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: ASCII signs that are neither letters nor digits.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The tokenizer's names for bytes that have no printable sign of their own.
_BYTE_NAMES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Characters of pieces that a worker remembers before it forgets those that it met once; some 250 MB.
_REMEMBERED = 8_000_000
#: Pieces that are encoded at a time.
_AT_ONCE = 8192

_encoders: dict[str, Encoder] = worker_table()


class _Places(dict):
    """Pieces numbered as they turn up; `new` holds those that were not known."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class Encoder:
    """Ids of texts, as the tokenizer gives them for each whole text without special tokens.

    The tokenizer (lower case, white space dropped) never joins over white space, nor letters with
    signs. So a text's ids are those of its pieces between white space, one after the other, and a piece that is
    a run of letters with signs after it has the ids of the two. Each different run is encoded once; pieces of any
    other form are encoded as they are. Most different pieces are met once only; these go when _REMEMBERED is reached.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merges = Tokenizer(self._tokenizer.model)  # for runs that are normal already
        self._clear()

    def _clear(self) -> None:
        self._held = 0
        self._pieces = _Places()
        self._again = np.zeros(0, bool)  # pieces met twice or more since the last _forget
        self._runs: dict[str, int] = {}
        self._of_piece = [np.zeros(0, np.int64)]  # runs of the pieces, one after the other
        self._piece_ends, self._run_ends = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self._ids = [np.zeros(0, np.uint32)]
        self._count, self._size = 0, 0

    def _forget(self) -> None:
        """Drops the pieces met once since the last time, or all where the others are most of what is remembered."""
        names = list(compress(self._pieces, self._again.tolist()))
        held = sum(map(len, names))
        if 2 * held > _REMEMBERED:
            self._clear()
            return
        of_piece, piece_ends = self._expand(np.flatnonzero(self._again), self._piece_ends[0], self._of_piece[0])
        kept = np.unique(of_piece)
        ids, run_ends = self._expand(kept, self._run_ends[0], self._ids[0])
        place = dict(zip(kept.tolist(), range(len(kept))))
        runs = {x: place[run] for x, run in self._runs.items() if run in place}
        self._clear()
        self._held, self._runs, self._again = held, runs, np.zeros(len(names), bool)
        self._pieces.update(zip(names, range(len(names))))
        self._of_piece, self._piece_ends = [np.searchsorted(kept, of_piece)], [piece_ends]
        self._ids, self._run_ends = [ids], [run_ends]
        self._count, self._size = len(kept), len(ids)

    def _add_run(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of new runs with these ids."""
        self._ids.append(ids)
        self._run_ends.append(np.cumsum(sizes) + self._size)
        self._size += len(ids)
        self._count += len(sizes)
        return self._count - len(sizes)

    def _learn(self, pieces: list[str]) -> None:
        other, made = [], []
        for piece in pieces:
            core = piece.rstrip(_SIGNS)
            if core.isalpha() and (core.isascii() or max(core) <= "ÿ"):
                low = core.lower()
                low = core if low == core else low  # one object for the two tables
                made.append((low, piece[len(core) :]) if len(core) < len(piece) else (low,))
            else:
                made.append((piece,))
                if core:
                    other.append(piece)
        odd = set(other)
        plain = chain.from_iterable(parts for parts in made if parts[0] not in odd)
        plain = [x for x in dict.fromkeys(plain) if x not in self._runs]
        if plain:
            named = [x.encode().decode("latin-1").translate(_BYTE_NAMES) for x in plain]
            got = self._merges.encode_batch([named], is_pretokenized=True, add_special_tokens=False)[0]
            sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(plain))
            first = self._add_run(np.array(got.ids, np.uint32), sizes)
            self._runs.update(zip(plain, range(first, first + len(plain))))
        whole = {}
        if other:
            got = [x.ids for x in self._tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            first = self._add_run(np.array(list(chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got]))
            whole = dict(zip(other, range(first, first + len(other))))
        before = int(self._piece_ends[-1][-1])
        self._of_piece.append(np.array([whole[x] if x in whole else self._runs[x] for parts in made for x in parts], np.int64))
        self._piece_ends.append(np.cumsum([len(parts) for parts in made]) + before)
        self._held += sum(map(len, pieces))

    @staticmethod
    def _expand(place: np.ndarray, ends: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the stretches `place`, one after the other, and how many come before each stretch)."""
        sizes = ends[place + 1] - ends[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return values[np.repeat(ends[place] - before[:-1], sizes) + np.arange(before[-1])], before

    def encode(self, texts: list[str | None], last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each followed by the id `last`; null is an empty text."""
        if self._held > _REMEMBERED:
            self._forget()
        split, odd = [], {}
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text or any(c in text for c in _ODD_SPACES):  # a special token may stand there
                odd[i] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                text = ""
            split.append(text.split())
        counts = [len(p) for p in split]
        known = len(self._pieces)
        place = np.fromiter(map(self._pieces.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        new, self._pieces.new = self._pieces.new, []
        for i in range(0, len(new), _AT_ONCE):
            self._learn(new[i : i + _AT_ONCE])
        met = np.bincount(place, minlength=len(self._pieces))
        self._again = np.concatenate([self._again | (met[:known] > 0), met[known:] > 1])
        for parts in (self._of_piece, self._piece_ends, self._run_ends, self._ids):
            if len(parts) > 1:
                parts[:] = [np.concatenate(parts)]
        runs, by_piece = self._expand(place, self._piece_ends[0], self._of_piece[0])
        ids, by_run = self._expand(runs, self._run_ends[0], self._ids[0])
        cut = by_run[by_piece[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]]
        parts, end = [], np.array([last], np.uint32)
        for i in range(len(texts)):
            parts += [odd.get(i, ids[cut[i] : cut[i + 1]]), end]
        size = [len(parts[2 * i]) + 1 for i in range(len(texts))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks of the worker find with what it remembers."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def texts_of(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
