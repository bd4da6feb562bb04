"""Small tables with awkward rows, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    parts = ["the", "ner", "tion", "ofa", "Zu", "ñol", "èk", "str", "wha", "ing", "lo", "mi"]
    out = ["".join(pick.choices(parts, k=pick.randint(1, 4))) for _ in range(words)]
    return "".join(w + (".\n" if pick.random() < 0.08 else " ") for w in out).strip()


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_words, kept): copies, near copies, shared passages, nulls, empty and long texts, a repeated row."""
    base, shared = prose(1, 200), prose(99, 60)
    words = base.split(" ")
    near = " ".join(w if i % 90 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 12 else "changed" for i, w in enumerate(words))
    texts = [base, base, near, far, prose(2, 80) + shared + prose(3, 80), shared + " " + prose(4, 90), prose(5, 6000)]
    texts += [None, "", " \n\t ", "one", "one two three four", "Ab", "ab", "x" * 5000, "\n".join(["Same line here."] * 40)]
    texts += [prose(20 + i, 70) for i in range(8)] + [near.upper(), "é" * 99, "é" * 60 + " " + "é" * 60, "a b c " * 300]
    rows = [(10 * (i % 7) + i, t, ["en", "de", None][i % 3], f"src{i % 2}", None, "x") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, prose(1, 200), "en", None, 3, None), (None, "alone " * 5, None, "s", 1, "k")]


SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))


def quality_facts(text: str | None) -> tuple:
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def shingles(text: str | None) -> frozenset:
    w = low_words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_classes(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[top(i)].append(d)
    return [(d, len(sets[i]), min(groups[top(i)], default=None)) for i, (d, _) in enumerate(rows)]


def repeats(rows: list[tuple[int, str | None]], least: int = 100) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, runs, kept), byte by byte; one row per doc_id."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - least + 1):
            x = raw[s : s + least]
            if x in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(x)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out[d] = (len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def hits(texts: list[str | None], items: list[tuple], window: int = 13) -> list[tuple]:
    """(n_words, hit words, items) of each text."""

    def split(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(_LOWER))

    owners = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            owners[tuple(w[i : i + window])].add("null" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in owners}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in owners:
                    hit.update(range(i, i + n))
                    found |= owners[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
