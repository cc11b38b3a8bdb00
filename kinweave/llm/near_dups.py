"""Operator 4: n-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of hashes of five successive words. Equal sets are one class, so copies are
counted and never compared. Classes meet where six of their 192 MinHash values (one of 32 bands)
agree. A pair is compared value by value: after each 24 values the posterior of its similarity
(uniform prior, binomial likelihood) is looked at, and the pair is dropped once the probability of
reaching the threshold is below ``tolerance``. The pairs left are verified on their whole sets.
Groups are the connected components of the verified links.

Large buckets are cut into hash blocks and pairs of blocks are the units of work; a unit holds at
most about 2 * ``block_rows`` documents and compares them in numpy. What leaves a unit is one row of
packed candidates, and after verification one row for each document (its number of links and one
member it is linked to), never a row for each pair. A pair that meets in several bands counts in the
first. A pair at the threshold is missed by all bands with a probability of 6e-5.

Cases: words are runs without ASCII white space, A-Z lower-cased; a text of one to four words is one
shingle of all its words; a text without words (null, empty, blank) is like no other text: its group
is itself and it has no links; ``near_duplicates`` takes a doc_id as the name of one text, and
``keep_one`` tells texts of one doc_id apart; rows without doc_id have no group and no links; equal rows count as copies of each other; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bytegrams import mixed, parts, word_hashes
from kinweave.llm.common import land, runs, text_column, text_slices
from kinweave.operators.graph import components
from kinweave.operators.ranking import first_per_key, number_rows

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
VALUES = BANDS * ROWS
STEP = 24  # MinHash values between two looks at the posterior
TOLERANCE = 1e-6
BLOCK_ROWS = 512
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: Sequence[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and the text of each."""
    found = [(np.array(rows, np.int64)[text], h) for rows, some in parts(texts) for h, text in [word_hashes(some)]]
    row = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    h = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
    start = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(start, len(row)))
    total = np.zeros(len(row), np.uint64)
    for j in range(words):
        near = np.zeros(len(row), np.uint64)
        near[:len(row) - j] = h[j:]
        near[:len(row) - j][row[:len(row) - j] != row[j:]] = 0
        total += mixed(near + np.uint64(j)) * _PLACES[j]
    place = np.arange(len(row)) - np.repeat(start, size)
    use = (place + words <= np.repeat(size, size)) | (place == 0)
    total, row = mixed(total[use]), row[use]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (total[1:] != total[:-1]) | (row[1:] != row[:-1])
    return total[new], row[new]


def minhash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The smallest value of each set under each function, in 16 bits."""
    out = np.empty((len(start), VALUES), np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat((h * _FACTORS[k]) >> np.uint64(24), start)
        out[:, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of each row; equal bands give equal keys."""
    v = values.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mixed((mixed(v * _BAND_FACTORS)).sum(2, dtype=np.uint64)).view(np.int64)


SKETCH = "doc_id long, k1 long, k2 long, n int, sig binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        h, row = shingles(text_column(b).to_pylist())
        start = np.flatnonzero(np.diff(row, prepend=-1))
        n = np.zeros(b.num_rows, np.int32)
        k1, k2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        sig: list[bytes | None] = [None] * b.num_rows
        if len(start):
            at = row[start]
            n[at] = np.diff(np.append(start, len(row)))
            k1[at] = np.add.reduceat(h, start).view(np.int64)
            k2[at] = np.add.reduceat(mixed(h ^ np.uint64(0x5DEECE66D)), start).view(np.int64)
            for r, s in zip(at.tolist(), minhash(h, start), strict=True):
                sig[r] = s.tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(k1), pa.array(k2), pa.array(n), pa.array(sig, pa.binary())], names=["doc_id", "k1", "k2", "n", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, VALUES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)), pa.array(keys.ravel())],
            names=["doc_id", "band", "key"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 * STEP, … values: the fewest equal ones with which a pair may still reach the threshold.

    The posterior of the similarity is Beta(m + 1, t - m + 1); its tail at the threshold is a binomial sum.
    """
    out = []
    for t in range(STEP, VALUES + 1, STEP):
        tail = 0.0
        for m in range(t + 1):
            tail += comb(t + 1, m) * threshold ** m * (1 - threshold) ** (t + 1 - m)
            if tail >= tolerance:
                out.append(m)
                break
    return out


def _candidates(threshold: float, tolerance: float):
    """For a map over units of (unit, band, side, rep, …): the pairs of a unit that pruning leaves."""
    least = least_matches(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            side = t.column("side").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            size, band = t.column("n").to_numpy(), t.column("band")[0].as_py()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j = np.triu_indices(len(a), 1) if not len(b) else (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
            i, j = a[i], (b if len(b) else a)[j]
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            keep = low >= threshold * high  # sets of other sizes cannot reach it
            i, j = i[keep], j[keep]
            same = np.zeros(len(i), np.int32)
            for step, m in enumerate(least):
                own = slice(step * STEP, (step + 1) * STEP)
                same = same + (sig[i, own] == sig[j, own]).sum(1, dtype=np.int32)
                keep = same >= m
                i, j, same = i[keep], j[keep], same[keep]
            first = np.concatenate([  # bands before this one in which the pair meets too
                (sig[i[s:s + 4096]] == sig[j[s:s + 4096]]).reshape(-1, BANDS, ROWS).all(2).argmax(1) for s in range(0, len(i), 4096)]
                or [np.zeros(0, np.int64)])
            i, j = i[first == band], j[first == band]
            if len(i):
                used, pairs = np.unique(np.stack([i, j]), return_inverse=True)
                cols = [t.column(c).take(pa.array(used)).combine_chunks() for c in ("rep", "k1", "copies")]
                members = pa.StructArray.from_arrays(cols, names=["rep", "k1", "copies"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.column("unit")[0].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), members),
                     pa.array([pairs.astype(np.int16).tobytes()], pa.binary())], names=["unit", "members", "pairs"])

    return prune


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) < 4 * len(sets):  # few pairs: each on its own
        return np.array([np.isin(sets[x], sets[y], assume_unique=True).sum() for x, y in zip(i, j, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[place] > 1
    owner, place = owner[use], np.unique(place[use], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, place[-1] + 1 if len(place) else 0, 4096):  # shingles of several sets, a strip of them at a time
        own = slice(*np.searchsorted(place, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[own], place[own] - lo] = 1
        both += m @ m.T
    return both[i, j].astype(np.int64)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "unit"):
            t = t.sort_by("pos")
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            i, j = np.frombuffer(next(x for x in t.column("pairs").to_pylist() if x is not None), np.int16).reshape(2, -1)
            size = np.array([len(s) for s in sets])
            both = intersections(sets, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            copies, n = t.column("copies").to_numpy(), len(sets)
            links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            root = np.arange(n)
            while True:  # the smallest member that can be reached within the unit
                low = np.minimum(root[i], root[j])
                after = root.copy()
                np.minimum.at(after, i, low)
                np.minimum.at(after, j, low)
                after = after[after]
                if (after == root).all():
                    break
                root = after
            some = np.flatnonzero(links > 0)
            rep = t.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[some]), pa.array(t.column("k1").to_numpy()[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[root[some]])],
                names=["rep", "k1", "links", "anchor"])

    return verify


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        h, row = shingles(text_column(b).to_pylist())
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        each = [h[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        k1 = np.array([x.sum(dtype=np.uint64) for x in each], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1), pa.array([x.tobytes() for x in each], pa.binary())],
                                         names=["rep", "k1", "shingles"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), n_copies and n_links (other documents at the threshold or above, copies among them)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = land(texts.mapInArrow(_sketch, SKETCH), "sketches")
    named = sketch.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = land(named.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("sig").alias("sig")), "classes")
    bands = land(classes.select("rep", "sig").mapInArrow(_bands, "rep long, band int, key long"), "bands")
    full = bands.groupBy("band", "key").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    blocks = F.ceil(F.col("m") / block_rows).cast("int")
    members = bands.join(full, ["band", "key"]).select("band", "key", "rep", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = units.select("rep", "band", F.xxhash64("band", "key", low, high).alias("unit"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    rows = units.join(classes.select("rep", "k1", "n", "copies", "sig"), "rep")
    found = land(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _candidates(threshold, tolerance), "unit long, members array<struct<rep:long,k1:long,copies:long>>, pairs binary"), "candidates")
    one = found.select("unit", "pairs", F.posexplode("members").alias("pos", "member")).select(
        "unit", "pos", "member.*", F.when(F.col("pos") == 0, F.col("pairs")).alias("pairs"))
    wanted = one.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "rep long, k1 long, shingles binary").dropDuplicates(["rep", "k1"])
    checked = land(one.join(sets, ["rep", "k1"]).repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _verify(threshold), "rep long, k1 long, links long, anchor long"), "links")
    linked = checked.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("rep").alias("src"), F.col("anchor").alias("dst")))
    of_class = classes.select("k1", "k2", "n", "rep", "copies").join(linked, ["rep", "k1"], "left").join(
        groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "k1", "k2", "n", F.coalesce("component", "rep").alias("class_id"), F.col("copies").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = named.select("doc_id", "k1", "k2", "n").join(of_class, ["k1", "k2", "n"]).select("doc_id", "class_id", "n_copies", "n_links")
    rest = sketch.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(rest)


def _text_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``: doc_id where it names one text, else a number of its own after all doc_ids for each text."""
    text = F.xxhash64(F.col("text").cast("string"), F.octet_length(F.col("text").cast("string")))
    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_d"), text.alias("_t"))
    several = own.groupBy("_d").agg(F.min("_t").alias("low"), F.max("_t").alias("high")).filter("low <> high").select("_d")
    texts = own.join(several, "_d", "left_semi").distinct()
    last = own.agg(F.max("_d")).first()[0] or 0
    # written, so that the usual, empty table is known to be small
    named = land(number_rows(texts, [], [F.col("_d"), F.col("_t")], "_n"), "texts")
    known = docs.withColumns({"_d": F.col("doc_id").cast("long"), "_t": text})
    return known.join(named, ["_d", "_t"], "left").withColumn("_id", F.coalesce(F.col("_n") + last, "_d")).drop("_d", "_t", "_n")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the first of each group; rows without doc_id stay.

    A document is a doc_id with its text. First is the smallest doc_id; where one doc_id stands for different
    texts, each of them is judged on its own and comes after the doc_ids that name one text. Of rows equal in
    doc_id and text the one stays whose columns have the smallest hash.
    """
    named = _text_ids(docs)
    result = near_duplicates(named.select(F.col("_id").alias("doc_id"), "text"), threshold)
    gone = result.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_id")).distinct()
    left = named.filter(F.col("_id").isNotNull()).join(gone, "_id", "left_anti")
    once = first_per_key(left, ["_id"], [F.xxhash64(*docs.columns)])
    return once.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
