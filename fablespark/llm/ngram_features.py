"""Vectorised indicator features of texts, as 48-bit codes.

A feature extractor takes a list of texts and yields ``(doc, code)`` arrays:
``doc`` is the position of the text in the list, ``code`` a hash of an n-gram
in the upper 48 bits of a 64-bit number. That is wide enough that collisions
do not matter, so that a long text does not gather false hits the way a small
hashed space would give; the lower 16 bits are free for ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)
#: Texts are handled in runs of about this many characters, to bound memory.
RUN_CHARS = 400_000


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Split texts into runs of bounded length (one text at least), with the first position."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if run and (size + len(t) > RUN_CHARS or len(run) == 1 << 16):
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t) + 3
    if run:
        yield start, run


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * _PRIME
    return (h ^ (h >> np.uint64(29))) & _HIGH


# ASCII characters that are no letters or digits count as a space.
_FOLD = np.array([c if chr(c).isalnum() or c == 0 else 32 for c in range(128)], dtype=np.uint32)


class CharNgrams:
    """Character n-grams of the lower-cased text, punctuation folded to spaces.

    A space stands before and after each text, so that an n-gram can be bound
    to the start or end of a word.
    """

    def __init__(self, orders: tuple[int, ...] = (4, 5, 6)) -> None:
        self.orders = orders

    def codes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cp = _points("".join(f"\0 {t.lower().replace(chr(0), ' ')} " for t in texts) + "\0")
        cp = np.where(cp < 128, _FOLD[cp & 127], cp)
        doc = np.cumsum(cp == 0, dtype=np.int32) - 1
        c = cp.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, max(self.orders) + 1):
            m = len(c) - n + 1
            if m <= 0:
                return
            h = h[:m] * _STEP + c[n - 1 :]
            if n in self.orders:
                whole = (doc[:m] == doc[n - 1 :]) & (cp[:m] != 0)
                yield doc[:m][whole], _mix(h[whole], n)


def _table(kind) -> np.ndarray:
    return np.array([kind(chr(c)) for c in range(0x250)] + [False], dtype=bool)


_UPPER, _LOWER = _table(str.isupper), _table(str.islower)
_ALNUM = np.concatenate([_table(str.isalnum)[:-1], [True]])
_SPACE = np.array([c in (9, 10, 11, 12, 13, 32, 0) for c in range(0x250)] + [False], dtype=bool)


class TokenShapes:
    """Words, and n-grams of token shapes, of the text as it is written.

    A token's shape is its letter case, length class, count of symbols, last
    symbol and whether it repeats the token before. Lines that repeat an
    earlier line of the text give one more feature.
    """

    def __init__(self, max_order: int = 3, words: bool = True) -> None:
        self.max_order, self.words = max_order, words

    def codes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cp = _points("".join(f"\0{t.replace(chr(0), ' ')}" for t in texts) + "\0")
        docs = np.cumsum(cp == 0, dtype=np.int32) - 1
        small = np.minimum(cp, 0x250)
        gap = _SPACE[small]
        edge = np.diff(gap.astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        if len(starts):
            doc = docs[starts]
            size = ends - starts

            def total(x: np.ndarray) -> np.ndarray:
                s = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                return s[ends] - s[starts]

            up, low, sym = total(_UPPER[small]), total(_LOWER[small]), total(~_ALNUM[small])
            place = np.arange(len(cp)) - np.repeat(starts, np.diff(np.append(starts, len(cp)))) if starts[0] == 0 else np.arange(len(cp)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(cp))))])
            powers = _STEP ** np.arange(64, dtype=np.uint64)
            weighed = (cp.astype(np.uint64) + np.uint64(1)) * powers[place & 63] * (np.uint64(1) + (place >> 6).astype(np.uint64))
            weighed[gap] = 0
            word = np.add.reduceat(weighed, starts)
            first_up = _UPPER[small[starts]]
            case = np.select([up + low == 0, (up == 0), first_up & (up == 1), (low == 0)], [0, 1, 2, 3], 4)
            last = np.where(_ALNUM[small[ends - 1]], 0, cp[ends - 1])
            again = np.concatenate([[False], (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])])
            length = np.searchsorted([2, 4, 8, 14], size, side="right")
            shape = _mix((((case * 8 + length) * 4 + np.minimum(sym, 3)) * 2 + again).astype(np.uint64) * np.uint64(1 << 21) + last.astype(np.uint64), 11)
            h = np.zeros(len(shape), dtype=np.uint64)
            for n in range(1, self.max_order + 1):
                m = len(shape) - n + 1
                if m <= 0:
                    break
                h = h[:m] * _STEP + shape[n - 1 :]
                whole = doc[:m] == doc[n - 1 :]
                yield doc[:m][whole], _mix(h[whole], 20 + n)
            if self.words:
                yield doc, _mix(word, 30)
        for i, t in enumerate(texts):
            lines = [x for x in map(str.strip, t.split("\n")) if x]
            if len(set(lines)) < len(lines):
                some = [1] if 2 * len(set(lines)) > len(lines) else [1, 2]
                yield np.full(len(some), i, np.int32), _mix(np.array(some, np.uint64), 40)


def indicators(extractor, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, code) pairs of one run of texts, in order of code."""
    parts = list(extractor.codes(texts))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    keys = np.concatenate([p[1] | p[0].astype(np.uint64) for p in parts])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys & ~_HIGH).astype(np.int32), keys & _HIGH
