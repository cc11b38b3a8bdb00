"""Words and byte n-grams of many texts at once, in numpy.

Texts are joined with a space between them and worked on as one array of bytes, about a million at
a time. A longer text is cut at spaces into parts that carry its row number, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

PART_BYTES = 1 << 20
SPACE = 32
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def parts(texts: Sequence[str], limit: int = PART_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and (parts of) texts, together about ``limit`` characters."""
    rows: list[int] = []
    some: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > limit:
                cut = text.rfind(" ", start + limit // 2, start + limit)
                end = cut + 1 if cut > 0 else start + limit
            rows.append(row)
            some.append(text[start:end] if start or end < len(text) else text)
            size += end - start
            if size >= limit:
                yield rows, some
                rows, some, size = [], [], 0
            start = end
            if start >= len(text):
                break
    if rows:
        yield rows, some


def joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a space before, between and after them; where each begins."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])[:-1]]).astype(np.int64)
    return np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves about half the bits of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * PART_BYTES)
        ones = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.append(ones, np.full(n - 1, m, np.uint64)), dtype=np.uint64) for m in (_MULTIPLIER, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def hash_spans(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    up, down = _powers(len(x) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[x] * up[:len(x)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.isin(np.arange(256), [SPACE, *range(9, 14)])


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) and the text of each."""
    x, begins = joined(texts)
    space = IS_SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # joined() begins and ends with a space
    starts, ends = edge[::2], edge[1::2]
    return hash_spans(LOWER[x], starts, ends), np.searchsorted(begins, starts, "right") - 1


#: for byte n-grams: lower-cased letters and bytes of other scripts, everything else is a space
FOLDED = np.where(np.isin(np.arange(256), [*range(97, 123), *range(128, 256)]), np.arange(256), SPACE).astype(np.uint8)
FOLDED[65:91] = np.arange(97, 123)
MASKS = np.array([(1 << 8 * m) - 1 for m in range(9)], np.uint64)


def word_grams(texts: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each letter, and at the space after each word, the last bytes back to the space before the word, at most k <= 8.

    Returns the grams (the newest byte lowest), the text of each, and which of them end a word.
    """
    raw, begins = joined(texts)
    x = FOLDED[raw]
    space = x == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] = False
    at = np.arange(len(x), dtype=np.int32)
    last = np.maximum.accumulate(np.where(space, at, 0))
    size = np.minimum(at[1:] - last[:-1] + 1, k)
    g = x.astype(np.uint64)
    out = g.copy()
    for j in range(1, k):
        out[j:] |= g[:-j] << np.uint64(8 * j)
    chosen = np.flatnonzero(keep)
    out = out[chosen] & MASKS[size[chosen - 1]]
    return out, np.searchsorted(begins, chosen, "right") - 1, space[chosen]


_KIND = np.where(IS_SPACE, 0, np.where(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), 1, 2)).astype(np.uint8)


def token_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits and of runs of marks, in their own case, and the text of each."""
    x, begins = joined(texts)
    kind = _KIND[x]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = edge[:-1], edge[1:]
    use = kind[starts] > 0
    starts, ends = starts[use], ends[use]
    return hash_spans(x, starts, ends), np.searchsorted(begins, starts, "right") - 1
