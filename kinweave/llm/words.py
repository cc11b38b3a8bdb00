"""Words of whole texts as hashes that are the same in every process, in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

from kinweave.llm.bytegrams import IS_SPACE, hash_spans, joined

PIECE_CHARS = 1 << 20
_SPACE = re.compile("[ \t-\r]")


def _pieces(text: str) -> Iterator[str]:
    """The text cut at white space; a longer word is not cut."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        space = _SPACE.search(text, start + PIECE_CHARS)
        if not space:
            break
        yield text[start:space.start()]
        start = space.start()
    yield text[start:] if start else text


def _hashed(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, begins = joined(some)
    space = IS_SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # joined() begins and ends with a space
    starts, ends = edge[::2], edge[1::2]
    of = np.searchsorted(begins, starts, "right") - 1
    return hash_spans(x, starts, ends), np.bincount(of, minlength=len(some))


def hashed_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, runs without ASCII white space, and the number of words of each text."""
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    counts = np.zeros(len(texts), np.int64)
    some: list[str] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        h, n = _hashed(some)
        hashes.append(h)
        np.add.at(counts, rows, n)

    for row, text in enumerate(texts):
        for piece in _pieces(text):
            some.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= PIECE_CHARS:
                flush()
                some, rows, size = [], [], 0
    if some:
        flush()
    return np.concatenate(hashes), counts
