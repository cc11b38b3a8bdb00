"""Sparse matrices in compressed rows, by hand: incidence, transpose and products row by row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    """Row i holds ``columns[starts[i]:starts[i + 1]]`` in ascending order, with ``values`` beside them."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int


def spans(lengths: np.ndarray) -> Csr:
    """Row i holds the ``lengths[i]`` columns that follow those of row i - 1: tokens by bytes."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    n = int(starts[-1])
    return Csr(starts, np.arange(n, dtype=np.int64), np.ones(n, np.int32), n)


def members(group_of: np.ndarray, groups: int) -> Csr:
    """Row i holds one column, its group: tokens by groups."""
    n = len(group_of)
    return Csr(np.arange(n + 1, dtype=np.int64), group_of.astype(np.int64), np.ones(n, np.int32), groups)


def transposed(m: Csr) -> Csr:
    """Columns as rows, by a stable counting of the columns."""
    rows = np.repeat(np.arange(len(m.starts) - 1, dtype=np.int64), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))]).astype(np.int64)
    return Csr(starts, rows[order], m.values[order], len(m.starts) - 1)


def expanded(a: Csr, b: Csr) -> np.ndarray:
    """For each row of ``a`` how many terms its row of the product sums, known before the product is made."""
    before = np.concatenate([[0], np.cumsum(b.starts[a.columns + 1] - b.starts[a.columns])])
    return before[a.starts[1:]] - before[a.starts[:-1]]


def row_products(a: Csr, b: Csr) -> Csr:
    """``a`` times ``b`` after Gustavson: each row sums the rows of ``b`` that its columns name, scaled by its values."""
    first = b.starts[a.columns]
    terms = b.starts[a.columns + 1] - first
    ends = np.cumsum(terms)
    n = int(ends[-1]) if len(ends) else 0
    at = np.arange(n, dtype=np.int64) + np.repeat(first - ends + terms, terms)
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1, dtype=np.int64), np.diff(a.starts)), terms)
    columns, values = b.columns[at], b.values[at] * np.repeat(a.values, terms)
    key = rows * b.width + columns
    if n and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, rows, columns, values = key[order], rows[order], columns[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(a.starts) - 1))]).astype(np.int64)
    return Csr(starts, columns[new], np.add.reduceat(values, new) if n else values, b.width)


def rows_of(m: Csr) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(m.starts) - 1, dtype=np.int64), np.diff(m.starts))


def blocks_of_rows(a: Csr, b: Csr, terms: int = 1 << 20) -> Iterator[tuple[int, Csr]]:
    """First row and rows of ``a`` in blocks whose product with ``b`` sums about ``terms`` terms; a row is never cut."""
    size = np.cumsum(expanded(a, b))
    row, n = 0, len(a.starts) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + terms, "right")))
        lo, hi = a.starts[row], a.starts[upto]
        yield row, Csr(a.starts[row:upto + 1] - lo, a.columns[lo:hi], a.values[lo:hi], a.width)
        row = upto
