"""Operator 13: passages that already stand in a document with a smaller doc_id, by prefix-partitioned suffix trees.

A suffix is the words of a document from one place on. Deep nodes of the suffix tree of all documents are
repeats; nodes of 13 words and more are all that matters here, so suffixes are cut there, and a leaf is named
by a 64-bit fingerprint of its 13 words. The tree is built in parts that fit a task:

1. Documents are dealt to slices of bounded bytes. A slice joins its equal suffixes to one leaf with the
   smallest doc_id, so a passage that stands everywhere leaves a slice once.
2. Variable-length prefixes split the leaves: bounds of groups are drawn from a bounded sample of suffixes and
   cut to the fewest words that tell two neighbours apart (one to four words; where even four words are too
   frequent, the fingerprint of the whole suffix goes on). Only the balance of the groups depends on the sample.
3. A group sorts its leaves and joins equal ones to the deep internal nodes of its subtree. A node's smallest
   doc_id tells each slice which of its leaves stand earlier elsewhere.
4. A slice marks all words that such windows cover. Windows that follow each other make one maximal repeat.

Cases: null, empty and short texts lose nothing; rows without doc_id are neither compared nor changed; rows of
one doc_id are one document and never repeat each other; exact copies lose all words but in the smallest
doc_id; a text of any length is one slice's at most; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bytegrams import mixed
from kinweave.llm.common import text_column, text_slices
from kinweave.llm.words import hashed_words

WINDOW = 13
SLICE_BYTES = 16 << 20
GROUP_BYTES = 16 << 20  # text whose suffixes make up a group, about
SAMPLE_BYTES = 16 << 20
SAMPLE_KEYS = 1 << 16
PREFIX_WORDS = 4
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
LEAVES = "grp int, slice long, keys binary, docs binary, counts binary"
OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
       "spans": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), "kept": pa.string()}
OUT_SCHEMA = ("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>, "
              "kept string")


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def suffixes(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place with a whole window: place in all words, number of the text and fingerprint; and words of each text."""
    h, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    at = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(ends, counts))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_MULTIPLIER, len(h)), dtype=np.uint64)])
    return at, text_of[at], mixed((sums[at + window] - sums[at]) * _powers(_INVERSE, len(h))[at]), h


def prefixes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first words of suffixes, 16 bits each, the first word highest; windows are longer than this."""
    out = np.zeros(len(at), np.uint64)
    for j in range(PREFIX_WORDS):
        out = (out << np.uint64(16)) | (h[at + j] >> np.uint64(48))
    return out


def group_bounds(prefix: np.ndarray, key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (prefix, fingerprint) of all groups but the first, from a sample of suffixes."""
    order = np.lexsort((key, prefix))
    prefix, key = prefix[order], key[order]
    places = np.unique((np.arange(1, groups) * len(prefix)) // groups) if len(prefix) else np.zeros(0, np.int64)
    bounds = []
    for i in places[places > 0].tolist():
        low, high = int(prefix[i - 1]), int(prefix[i])
        if low == high:
            bounds.append((high, int(key[i])))
            continue
        words = next(w for w in range(1, PREFIX_WORDS + 1) if low >> 16 * (PREFIX_WORDS - w) != high >> 16 * (PREFIX_WORDS - w))
        cut = 16 * (PREFIX_WORDS - words)
        bounds.append((high >> cut << cut, 0))
    bounds = sorted(set(bounds))
    return np.array([b[0] for b in bounds], np.uint64), np.array([b[1] for b in bounds], np.uint64)


def group_of(prefix: np.ndarray, key: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at_prefix, at_key = bounds
    out = np.searchsorted(at_prefix, prefix, "right")
    for frequent in np.unique(at_prefix[at_key > 0]):
        first, last = np.searchsorted(at_prefix, frequent, "left"), np.searchsorted(at_prefix, frequent, "right")
        same = np.flatnonzero(prefix == frequent)
        out[same] = first + np.searchsorted(at_key[first:last], key[same], "right")
    return out.astype(np.int32)


def _ordered(rows: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Documents of a slice in ascending doc_id; a null doc_id comes first."""
    rows = rows.sort_by([("doc_id", "ascending")])
    ids = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = rows.column("text").to_pylist()
    return ids[order], [texts[i] or "" for i in order.tolist()]


def _leaves(window: int, bounds: tuple[np.ndarray, np.ndarray]):
    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        ids, texts = _ordered(rows)
        known = np.searchsorted(ids, np.iinfo(np.int64).min, "right")  # rows without doc_id do not take part
        at, text, finger, h = suffixes(texts[known:], window)
        first = np.sort(np.unique(finger, return_index=True)[1])  # a leaf's first place has its smallest doc_id
        at, text, finger = at[first], text[first], finger[first]
        group = group_of(prefixes(h, at), finger, bounds)
        order = np.argsort(group, kind="stable")
        group, text, finger = group[order], text[order], finger[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        out: list[list] = [[], [], [], [], []]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
            if lo < hi:
                turn = np.flatnonzero(np.diff(text[lo:hi], prepend=-1))
                docs = ids[known:][text[lo:hi][turn]]
                for side, value in zip(out, (group[lo], key[0].as_py(), finger[lo:hi].tobytes(), docs.tobytes(),
                                             np.diff(turn, append=hi - lo).astype("<i4").tobytes()), strict=True):
                    side.append(value)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["grp", "slice", "keys", "docs", "counts"])

    return solve


def _subtree(_: tuple, rows: pa.Table) -> pa.Table:
    """Deep nodes of one group; for each slice its leaves that have a smaller doc_id in another slice."""
    slices = rows.column("slice").to_pylist()
    blobs = {c: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)] for c, kind in (("keys", "<u8"), ("docs", "<i8"), ("counts", "<i4"))}
    leaf = np.concatenate(blobs["keys"])
    doc = np.concatenate([np.repeat(d, n) for d, n in zip(blobs["docs"], blobs["counts"], strict=True)])
    order = np.argsort(leaf)
    node = np.flatnonzero(np.concatenate([[True], np.diff(leaf[order]) != 0]))
    size = np.diff(node, append=len(leaf))
    least = np.minimum.reduceat(doc[order], node)
    later = np.empty(len(leaf), bool)
    later[order] = doc[order] > np.repeat(least, size)
    ends = np.cumsum([len(k) for k in blobs["keys"]])
    hits = [leaf[lo:hi][later[lo:hi]] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    got = [(s, h.tobytes()) for s, h in zip(slices, hits, strict=True) if len(h)]
    return pa.Table.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([h for _, h in got], pa.binary())], names=["slice", "hits"])


def _mark(window: int, with_text: bool):
    def solve(_: tuple, rows: pa.Table, hits: pa.Table) -> pa.Table:
        ids, texts = _ordered(rows)
        known = int(np.searchsorted(ids, np.iinfo(np.int64).min, "right"))
        at, text, finger, h = suffixes(texts, window)
        own = ids[text]
        use = text >= known
        at, own, finger = at[use], own[use], finger[use]
        leaves, first, leaf_of = np.unique(finger, return_index=True, return_inverse=True)
        earlier = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), "<u8") for x in hits.column("hits"))]))
        place = np.minimum(np.searchsorted(earlier, leaves), max(0, len(earlier) - 1))
        elsewhere = earlier[place] == leaves if len(earlier) else np.zeros(len(leaves), bool)
        repeated = at[(own > own[first][leaf_of]) | elsewhere[leaf_of]]
        n = len(h)
        covered = np.cumsum(np.bincount(repeated, minlength=n + 1) - np.bincount(repeated + window, minlength=n + 1)[:n + 1])[:n] > 0
        out: list[list] = [[] for _ in OUT]
        start = 0
        for d, t in zip(ids.tolist(), texts, strict=True):
            words = t.encode().split()
            gone = covered[start:start + len(words)]
            start += len(words)
            n_gone = int(gone.sum())
            kept = b" ".join(compress(words, (~gone).tolist()) if n_gone else words)
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist() if n_gone else []
            spans = [{"start": lo, "length": hi - lo} for lo, hi in zip(edge[::2], edge[1::2], strict=True)]
            for side, value in zip(out, (None if d == np.iinfo(np.int64).min else d, len(words), n_gone, hashlib.sha256(kept).hexdigest(),
                                         spans, kept.decode() if with_text else None), strict=True):
                side.append(value)
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, OUT.values(), strict=True)], names=list(OUT))

    return solve


def _sampled(window: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            at, _, finger, h = suffixes(text_column(b).to_pylist(), window)
            some = np.flatnonzero(finger % np.uint64(16) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(prefixes(h, at[some]).view(np.int64)), pa.array(finger[some].view(np.int64))], names=["prefix", "finger"])

    return solve


def drop_repeats(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, group_bytes: int = GROUP_BYTES,
                 with_text: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256, the removed spans of words, and the kept words."""
    if window < PREFIX_WORDS:
        raise ValueError(f"a window has {PREFIX_WORDS} words at least")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = max(1, total // SAMPLE_BYTES)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    keys = sample.select("doc_id", "text").mapInArrow(_sampled(window), "prefix long, finger long").orderBy("finger").limit(SAMPLE_KEYS).toPandas()
    bounds = group_bounds(keys["prefix"].to_numpy(np.int64).view(np.uint64), keys["finger"].to_numpy(np.int64).view(np.uint64),
                          max(1, -(-total // group_bytes)))
    # a text's hash beside its doc_id: rows of one doc_id do not gather in a slice
    slices = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(max(1, -(-total // slice_bytes)))))
    leaves = slices.groupBy("slice").applyInArrow(_leaves(window, bounds), LEAVES)
    hits = leaves.groupBy("grp").applyInArrow(_subtree, "slice long, hits binary").withColumnRenamed("slice", "of_slice")
    return slices.groupBy("slice").cogroup(hits.groupBy("of_slice")).applyInArrow(_mark(window, with_text), OUT_SCHEMA)
