"""Operator 12: runs of words, that is maximal stretches that repeat with some period.

Periods are taken octave by octave: for periods from 2^k to 2^(k+1) a document is cut into tiles around
boundaries 2^k words apart, each tile reaching 2^k words back and 3 * 2^k forward. At its boundary c a tile
has two Z-functions, one forward and one backward: for each period q of the octave how far the words from c
equal those from c + q. Both are found for all periods at once, by doubling steps over prefix hashes. Where
they are long enough, words q apart agree on an interval around c, a fragment of a run. A run of length 2q at
least holds a boundary of its octave, so each run leaves fragments at all boundaries that it holds, and those
of neighbouring tiles touch. Spark shuffles fragments by document and period and stitches them; of runs over
one stretch that with the smallest period stays.

Tiles do not depend on each other. A document of up to ``tile_words`` words is solved where it is read; a
longer one is exploded into rows of tiles, octave by octave, that any task can solve. Only documents with
fragments travel on with their words.

Cases: null and empty texts have no words and no runs; a document of one repeated word is one run of period 1;
equal rows give equal rows; rows of one doc_id with different texts are separate; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.bytegrams import mixed
from kinweave.llm.common import land, text_column, text_slices

LEAST_WORDS = 12
TILE_WORDS = 1 << 16
FIRST_STEP = 4  # a run leaves at least 6 equal words, so boundaries need not be nearer
BLOCK_BYTES = 1 << 20
KEY = "k1 long, k2 long"
FOUND = (f"{KEY}, doc_id long, n_words long, words binary, whole_sha256 string, fragments array<struct<period:long,low:long,high:long>>, "
         "tiles array<struct<octave:int,first:long,last:long,start:long,codes:binary>>")
OUT_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
              "collapsed_sha256 string, n_words long")
FRAGMENT = pa.struct([("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
TILE = pa.struct([("octave", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("codes", pa.binary())])
_MULTIPLIER = 0x9E3779B97F4A7C15


class Fragments(NamedTuple):
    """Stretches ``low <= t < high`` on which word t equals word t + period."""

    period: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, which: np.ndarray) -> Fragments:
        return Fragments(self.period[which], self.low[which], self.high[which])


NONE = Fragments(*[np.zeros(0, np.int64)] * 3)


class _Words:
    """Codes of words with prefix hashes: how far two places agree, for many pairs of places at once."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        powers = np.full(n + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.codes, self.n = codes, n
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[:n], dtype=np.uint64)])

    def agree(self, at: np.ndarray, period: np.ndarray, reach: int, back: bool) -> np.ndarray:
        """Words from ``at`` on, or before it, that equal those a period later, ``reach`` at most."""
        most = np.minimum(reach, at if back else self.n - at - period)
        done = np.zeros(len(at), np.int64)
        step = 1 << reach.bit_length()
        while step:
            more = np.flatnonzero(done + step <= most)
            start = at[more] - done[more] - step if back else at[more] + done[more]
            q = period[more]
            same = (self.sums[start + step] - self.sums[start]) * self.powers[q] == self.sums[start + q + step] - self.sums[start + q]
            done[more[same]] += step
            step >>= 1
        return done


def solve_octave(words: _Words, octave: int, ends: np.ndarray, first: int = 0, last: int | None = None) -> Fragments:
    """Fragments of the tiles whose boundaries lie in ``first`` to ``last``; ``ends`` has the end of the text at each word."""
    low = 1 << octave
    step = max(FIRST_STEP, low)
    x, n = words.codes, words.n
    at = np.arange(-(-first // step) * step, n if last is None else min(last, n), step, dtype=np.int64)
    if not len(at):
        return NONE
    if low < FIRST_STEP:
        hits = []
        for q in range(low, 2 * low):
            c = at[at + q < n]
            c = c[x[c] == x[c + q]]
            hits.append((c, np.full(len(c), q, np.int64)))
        c, q = (np.concatenate(side) for side in zip(*hits, strict=True))
    else:
        following = np.zeros(len(at) * low, np.uint64)
        some = x[at[0] + low:at[0] + low + len(following)]
        following[:len(some)] = some
        tile, place = np.nonzero(following.reshape(len(at), low) == x[at][:, None])
        c, q = at[tile], place + low
    inside = c + q < ends[c]
    c, q = c[inside], q[inside]
    onward = (c + q + 1 < n) & (x[np.minimum(c + 1, n - 1)] == x[np.minimum(c + q + 1, n - 1)])
    before = (c > 0) & (x[np.maximum(c - 1, 0)] == x[np.maximum(c - 1, 0) + q])
    c, q = c[onward | before], q[onward | before]
    forward, backward = words.agree(c, q, step, False), words.agree(c, q, step, True)
    enough = forward + backward >= np.minimum(step, np.maximum(q, LEAST_WORDS - q))
    return Fragments(q, c - backward, c + forward).take(enough)


def stitched(parts: list[Fragments]) -> Fragments:
    """Touching fragments of one period as one."""
    f = Fragments(*(np.concatenate(side) for side in zip(*parts, strict=True))) if parts else NONE
    f = f.take(np.lexsort((f.low, f.period)))
    if not len(f.low):
        return f
    changed = np.concatenate([[True], f.period[1:] != f.period[:-1]])
    shift = np.cumsum(changed) * (int(f.high.max()) + 1)  # periods apart from each other on one line
    reached = np.maximum.accumulate(f.high + shift)
    new = np.concatenate([[True], (f.low + shift)[1:] > reached[:-1]])
    at = np.flatnonzero(new)
    return Fragments(f.period[at], f.low[at], np.maximum.reduceat(f.high, at))


def _long_enough(f: Fragments) -> np.ndarray:
    return f.high - f.low >= np.maximum(f.period, LEAST_WORDS - f.period)


def octaves(n_words: int) -> range:
    """Octaves of the periods that a run of a document can have."""
    return range(max(0, (n_words // 2).bit_length()))


def runs_of_texts(texts: list[np.ndarray]) -> list[Fragments]:
    """All stretches of a run's length, for each text's codes; multiples of periods are still among them."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for i, (t, s) in enumerate(zip(texts, starts.tolist(), strict=True)):
        codes[s:s + len(t)] = t
        codes[s + len(t)] = i + 1  # a mark of its own ends each text
    words = _Words(codes)
    end_at = np.repeat(ends - 1, sizes)
    f = stitched([solve_octave(words, k, end_at) for k in octaves(max(map(len, texts), default=0))])
    f = f.take(_long_enough(f))
    of = np.searchsorted(ends, f.low, "right")
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return [f.take(order[lo:hi])._replace(low=f.low[order[lo:hi]] - s, high=f.high[order[lo:hi]] - s)
            for lo, hi, s in zip(cuts[:-1], cuts[1:], starts.tolist(), strict=True)]


def tiles_of(codes: np.ndarray, tile_words: int) -> list[dict]:
    """A long text as tiles: the short octaves share tiles, each longer octave has its own, four of its periods long."""
    n = len(codes)
    small = np.unique(codes, return_inverse=True)[1].astype("<u4")
    out = []
    shared = max(0, (tile_words // 4).bit_length() - 1)
    for k in octaves(n):
        if k < shared:
            continue
        core, reach = (tile_words, 1 << k) if k == shared else (4 << k, 1 << k)
        for first in range(0, n, core):
            lo, hi = max(0, first - reach), min(n, first + core + 3 * reach)
            out.append({"octave": -k - 1 if k == shared else k, "first": first, "last": min(n, first + core), "start": lo,
                        "codes": small[lo:hi].tobytes()})
    return out


def solve_tile(octave: int, first: int, last: int, start: int, codes: bytes) -> Fragments:
    """Fragments of one tile; a negative octave stands for all octaves up to it."""
    x = mixed(np.frombuffer(codes, "<u4").astype(np.uint64) + np.uint64(1))
    words, ends = _Words(x), np.full(len(x), len(x), np.int64)
    parts = []
    for k in [octave] if octave >= 0 else range(-octave):
        # boundaries are multiples of the step in the document, whatever the tile's own start
        step = max(FIRST_STEP, 1 << k)
        shift = start % step
        pad = np.concatenate([np.arange(1, shift + 1, dtype=np.uint64) << np.uint64(40), x]) if shift else x
        padded, pad_ends = (_Words(pad), np.full(len(pad), len(pad), np.int64)) if shift else (words, ends)
        f = solve_octave(padded, k, pad_ends, first - start + shift, last - start + shift)
        parts.append(Fragments(f.period, f.low + (start - shift), f.high + (start - shift)))
    return stitched(parts)


def repeated_part(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query: in a tenth of the documents, by the hash of doc_id, a part is repeated to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _find(tile_words: int, change):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, BLOCK_BYTES):
            ids = b.column(0).to_pylist()
            words = [change(t.encode().split(), d) for d, t in zip(ids, text_column(b).to_pylist(), strict=True)]
            codes = [np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64) for w in words]
            brief = [len(w) <= tile_words for w in words]
            found = iter(runs_of_texts([c for c, short in zip(codes, brief, strict=True) if short]))
            rows: dict[str, list] = {k: [] for k in ("k1", "k2", "n_words", "words", "whole", "fragments", "tiles")}
            for d, w, c, short in zip(ids, words, codes, brief, strict=True):
                joined = b" ".join(w)
                f = next(found) if short else NONE
                tiles = [] if short else tiles_of(c, tile_words)
                key = np.frombuffer(xxhash.xxh3_128_digest(f"{d} ".encode() + joined), "<i8")
                travels = len(f.low) or tiles
                for name, value in zip(rows, (key[0], key[1], len(w), joined if travels else None,
                                              None if travels else hashlib.sha256(joined).hexdigest(),
                                              [dict(zip(("period", "low", "high"), x, strict=True)) for x in zip(*(s.tolist() for s in f), strict=True)],
                                              tiles), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows["k1"], pa.int64()), pa.array(rows["k2"], pa.int64()), b.column(0), pa.array(rows["n_words"], pa.int64()),
                pa.array(rows["words"], pa.binary()), pa.array(rows["whole"], pa.string()),
                pa.array(rows["fragments"], pa.list_(FRAGMENT)), pa.array(rows["tiles"], pa.list_(TILE)),
            ], names=["k1", "k2", "doc_id", "n_words", "words", "whole_sha256", "fragments", "tiles"])

    return solve


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            f = solve_tile(row["octave"], row["first"], row["last"], row["start"], row["codes"])
            n = len(f.low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["k1"]] * n, pa.int64()), pa.array([row["k2"]] * n, pa.int64()), *map(pa.array, f)],
                names=["k1", "k2", "period", "low", "high"])


def stitch(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Touching fragments of one document and period as one row."""
    group = [*keys, "period"]
    order = Window.partitionBy(*group).orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("_new", (F.coalesce(F.col("low") > reached, F.lit(True))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of documents with their runs (low, end, period)."""
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for row in b.to_pylist():
            runs = sorted((r["low"], r["end"], r["period"]) for r in row["runs"] or ())
            words = row["words"].split(b" ") if row["n_words"] else []
            gone = np.zeros(len(words) + 1, np.int32)
            for low, end, period in runs:
                gone[low + period] += 1
                gone[end] -= 1
            kept = [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]
            best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
            figures = (None,) * 4 if best is None else (
                best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
            text = "".join(f"{low},{end - low},{period}\n" for low, end, period in runs)
            for side, value in zip(out, (row["doc_id"], len(runs), *figures, hashlib.sha256(text.encode()).hexdigest(),
                                         hashlib.sha256(b" ".join(kept)).hexdigest(), row["n_words"]), strict=True):
                side.append(value)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                         names=[c.split()[0] for c in OUT_SCHEMA.split(", ")])


def _found(docs: DataFrame, tile_words: int, change) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return land(texts.mapInArrow(_find(tile_words, change), FOUND), "periods", compression="zstd")


def _runs(found: DataFrame) -> DataFrame:
    """k1, k2, low, end, period of each run."""
    length: Column = F.col("high") - F.col("low")
    near = found.filter(F.size("fragments") > 0).select("k1", "k2", F.explode("fragments").alias("x")).select("k1", "k2", "x.*")
    tiles = found.filter(F.size("tiles") > 0).select("k1", "k2", F.explode("tiles").alias("x")).select("k1", "k2", "x.*")
    far = tiles.repartition("k1", "k2", "octave", "first").mapInArrow(_solve_tiles, f"{KEY}, period long, low long, high long")
    whole = stitch(near.unionByName(far), ["k1", "k2"]).filter(length >= F.greatest(F.col("period"), LEAST_WORDS - F.col("period")))
    return whole.groupBy("k1", "k2", "low", (F.col("high") + F.col("period")).alias("end")).agg(F.min("period").alias("period"))


def runs(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """Each run of each document: doc_id, start, length, period; once for rows equal in doc_id and text."""
    found = _found(docs, tile_words, lambda words, _: words)
    ids = found.select("k1", "k2", "doc_id").distinct()
    return _runs(found).join(ids, ["k1", "k2"]).select("doc_id", F.col("low").alias("start"), (F.col("end") - F.col("low")).alias("length"), "period")


def periodic(docs: DataFrame, tile_words: int = TILE_WORDS, change=lambda words, _: words) -> DataFrame:
    """One row for each document: number of runs, the longest, and digests of all runs and of the words without repeats.

    ``change`` (words, doc_id) may replace the words of a document before.
    """
    found = _found(docs, tile_words, change)
    per_doc = _runs(found).groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "end", "period")).alias("runs"))
    travels = found.filter(F.col("words").isNotNull()).select("k1", "k2", "doc_id", "n_words", "words")
    with_runs = travels.join(per_doc, ["k1", "k2"], "left").select("doc_id", "n_words", "words", "runs").mapInArrow(_spans, OUT_SCHEMA)
    none = F.lit(None).cast("long")
    without = found.filter(F.col("words").isNull()).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"),
        F.col("whole_sha256").alias("collapsed_sha256"), "n_words")
    return with_runs.unionByName(without)
