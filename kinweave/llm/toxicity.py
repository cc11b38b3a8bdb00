"""Operator 8: toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, share their backoff: the orders below the top one are continuation
counts (numbers of different histories) gathered from all documents, labelled or not, so a rare
expression costs either class the same until labelled texts tell them apart. The top order is an
absolutely discounted count from labelled texts of one class; its history reaches back to the word's
beginning as far as 8 bytes go, so a stem is told apart whatever is hung on it. A text's figures are its
log-likelihood ratio per letter; how far its telling words, those whose own ratio is above ``TELLING``,
reach beyond it, summed; and its number of words, as a sum over more words holds more chance hits. The
last two go in as logarithms. A logistic curve fitted on labelled texts that the counts have not seen turns
the figures into a probability.

N-grams are counted exactly, as rows: tasks add up what they meet and send it on, so what is gathered
grows with the input. The driver and the tasks hold only the grams of counted labelled texts (at most
``fit_rows`` rows, no matter how many documents there are), with lower orders from the counts of all
documents. That is the whole model: for a gram that no labelled text holds, the shared backoff is the
same factor in both classes, so its ratio is that of its history alone, and 0 where neither class has
the history. Labels are taken from at most ``fit_rows`` labelled
rows (all of them up to that bound, else those with the smallest hashes of their ids): two thirds
count, one third sets the curve. Figures of all texts are computed where the rows are read.

Cases: null and empty texts, and texts without a letter, have figures of 0; a word of any length counts once; equal rows get equal
scores; a null doc_id is scored and never held out; rows of one doc_id are scored on their own
texts; without labels of both kinds every score is 0 (nothing is rejected); an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bytegrams import MASKS, mixed, parts, word_grams
from kinweave.llm.common import FIT_ROWS, fold, ids_of, land, sample, text_column, text_slices

TOP, MIDDLE, LOW = 8, 6, 2  # bytes of a gram at each order; below them single bytes
TELLING = 2.0  # log-likelihood ratio from which a word tells
FIGURES = ["whole", "telling", "words"]
HELD_GRAMS = 1 << 20
DISCOUNT = 0.75
REJECT_FROM = 0.3
COUNT_SCHEMA = "gram long, n_ordinary long, n_toxic long"
_HISTORY = np.uint64(1 << 56)


def places(grams: np.ndarray) -> np.ndarray:
    """Where a gram is counted: its own bytes, as a number that Spark has."""
    return grams.astype(np.int64)


def _add_up(rows: list[np.ndarray]) -> np.ndarray:
    """Columns (gram, ordinary, toxic) with one column for each gram."""
    rows = np.concatenate(rows, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    return np.vstack([rows[:1, first], np.add.reduceat(rows[1:], first, axis=1)])


def _count(ids: np.ndarray, classes: np.ndarray, held_grams: int = HELD_GRAMS):
    """For a map over (doc_id, text): the grams that a task has met, added up over about ``held_grams`` of them."""

    def sent(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(r[lo:lo + (1 << 16)]) for r in rows], names=["gram", "n_ordinary", "n_toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, 0
        for b in text_slices(batches):
            docs = ids_of(b)
            at = np.minimum(np.searchsorted(ids, docs), max(len(ids) - 1, 0))
            kinds = np.where(ids[at] == docs, classes[at], -1) if len(ids) else np.full(len(docs), -1)
            for rows, texts in parts(text_column(b).to_pylist()):
                g, text, _ = word_grams(texts, TOP)
                if not len(g):
                    continue
                p = places(g)
                y = kinds[np.array(rows)][text]
                p_sorted = np.sort(p)
                met = np.zeros((3, np.count_nonzero(p_sorted[1:] != p_sorted[:-1]) + 1), np.int64)
                met[0] = p_sorted[np.append(True, p_sorted[1:] != p_sorted[:-1])]
                for c in (0, 1):
                    if (y == c).any():
                        own, n = np.unique(p[y == c], return_counts=True)
                        met[1 + c, np.searchsorted(met[0], own)] = n
                held.append(met)
                size += met.shape[1]
                if size > held_grams + known:
                    held = [_add_up(held)]
                    known = size = held[0].shape[1]
                    if size > held_grams:
                        yield from sent(held[0])
                        held, size, known = [], 0, 0
        if held:
            yield from sent(_add_up(held))

    return count


def _discounted(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    known = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1)
    return np.where(total > 0, known, lower)


def _by_history(n: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories, the sum of n within each and how many grams have a count there."""
    histories, at = np.unique(history, return_inverse=True)
    return histories, np.bincount(at, weights=n), np.bincount(at, weights=n > 0)


def backoff(grams: np.ndarray, middles: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray,
            lows: np.ndarray, n_low: np.ndarray) -> np.ndarray:
    """Probability of the newest byte of each gram by the orders below the top one.

    ``middles`` (ascending) holds those of the grams with their continuation counts and the sum and number of
    counts within their histories; ``lows`` (ascending) holds all low grams with their continuation counts.
    """
    last = (lows & np.uint64(255)).astype(np.int64)
    histories = np.bincount(last, minlength=256) + 0.1
    shared = (histories / histories.sum())[last]
    of, sums, sorts = _by_history(n_low.astype(float), lows >> np.uint64(8))
    at = np.searchsorted(of, lows >> np.uint64(8))
    shared = _discounted(n_low, sums[at], sorts[at], shared)
    shared = _discounted(n, total, kinds, shared[np.searchsorted(lows, middles & MASKS[LOW])])
    return shared[np.searchsorted(middles, grams & MASKS[MIDDLE])]


class Ratios:
    """log P(toxic) - log P(ordinary) by gram: its own if labelled texts hold it, else its history's, else 0.

    Keys lie in the order of the top bits of a hash; a lookup walks the few keys that share them.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(len(keys)).bit_length(), 1)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.start = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for those that are not there."""
        found = np.full(len(keys), -1, np.int32)
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            found[left[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end)
            left, at, end = left[on], at[on], end[on]
        return found

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        shape, grams = np.shape(place), np.atleast_1d(place).astype(np.uint64)
        if not len(self.keys):
            return np.zeros(shape, np.float32)
        at = self._find(grams)
        lost = np.flatnonzero(at < 0)
        at[lost] = self._find(grams[lost] >> np.uint64(8) | _HISTORY)
        return np.where(at < 0, np.float32(0), self.values[at]).reshape(shape)


def ratios(place: np.ndarray, grams: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, shared: np.ndarray | None = None) -> Ratios:
    """The ratios of all grams from those of labelled texts; without ``shared``, ``grams`` are those of all documents."""
    if not len(grams) or not ordinary.any() or not toxic.any():
        return Ratios(np.zeros(0, np.uint64), np.zeros(0))
    if shared is None:
        middles, n = np.unique(grams & MASKS[MIDDLE], return_counts=True)
        of, sums, sorts = _by_history(n.astype(float), middles >> np.uint64(8))
        at = np.searchsorted(of, middles >> np.uint64(8))
        shared = backoff(grams, middles, n, sums[at], sorts[at], *np.unique(middles & MASKS[LOW], return_counts=True))
    history = grams >> np.uint64(8)
    by_class, unseen = [], []
    for n in (ordinary, toxic):
        histories, sums, sorts = _by_history(n.astype(float), history)
        at = np.searchsorted(histories, history)
        by_class.append(_discounted(n, sums[at], sorts[at], shared))
        unseen.append(_discounted(np.zeros(1), sums, sorts, np.ones(1)))  # times the shared backoff, which cancels
    met = ordinary + toxic > 0
    own = (np.log(by_class[1]) - np.log(by_class[0]))[met]
    return Ratios(np.concatenate([place[met].astype(np.uint64), histories | _HISTORY]),
                  np.concatenate([own, np.log(unseen[1]) - np.log(unseen[0])]))


def model(rows: DataFrame, ids: np.ndarray, classes: np.ndarray) -> tuple[Ratios, bool]:
    """The ratios by all documents and the labels of some, and whether any toxic gram was counted."""
    met = land(rows.mapInArrow(_count(ids, classes), COUNT_SCHEMA).groupBy("gram").agg(
        F.sum("n_ordinary").alias("n_ordinary"), F.sum("n_toxic").alias("n_toxic")), "grams")
    middle = F.col("gram").bitwiseAND(F.lit(int(MASKS[MIDDLE])))
    middles = land(met.groupBy(middle.alias("middle")).agg(F.count("*").alias("n")), "middles")
    labelled = met.filter("n_ordinary + n_toxic > 0")
    history = F.shiftright("middle", 8)
    sums = middles.groupBy(history.alias("history")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    wanted = labelled.select(middle.alias("middle")).distinct()
    used = middles.join(wanted, "middle").withColumn("history", history).join(sums, "history").select("middle", "n", "total", "kinds")
    lows = middles.groupBy(F.col("middle").bitwiseAND(F.lit(int(MASKS[LOW]))).alias("low")).agg(F.count("*").alias("n"))
    grams, ordinary, toxic = _columns(labelled)  # of at most fit_rows texts
    if not len(grams):
        return Ratios(np.zeros(0, np.uint64), np.zeros(0)), False
    mid, n, total, kinds = _columns(used)  # no more than the labelled grams
    low, n_low = _columns(lows)  # at most 2**16
    shared = backoff(grams.astype(np.uint64), mid.astype(np.uint64), n, total, kinds, low.astype(np.uint64), n_low)
    return ratios(grams, grams.astype(np.uint64), ordinary, toxic, shared), bool(toxic.any())


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A table of bounded size as arrays, in the order of its first column."""
    got = df.toArrow()
    columns = [c.to_numpy() for c in got.columns]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def figures(texts: list[str], table: Ratios) -> np.ndarray:
    """For each text: ratio per letter, log(1 + what its words' ratios have above TELLING), log(1 + number of words)."""
    n = len(texts)
    total, size, telling, words = np.zeros((4, n))
    for rows, some in parts(texts):
        g, text, ends = word_grams(some, TOP)
        if not len(g):
            continue
        row, r = np.array(rows)[text], table[places(g)].astype(np.float64)
        total += np.bincount(row, r, n)
        size += np.bincount(row, minlength=n)
        stop = np.flatnonzero(ends)
        of_word = np.add.reduceat(r, np.concatenate([[0], stop[:-1] + 1]))
        telling += np.bincount(row[stop], np.maximum(of_word - TELLING, 0), n)
        words += np.bincount(row[stop], minlength=n)
    return np.array([total / np.maximum(size, 1), np.log1p(telling), np.log1p(words)]).T


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept of a ridge-penalised logistic curve, by Newton steps."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    pull = ridge * len(x) * np.append(np.ones(x.shape[1]), 0) / 100 + 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(pull), a.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and the figures of every document; labels teach, and are no input of a score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids, classes, folds = sample(labels, "toxic", fit_rows)
    counting = folds != 3
    learned, any_toxic = model(rows, ids[counting], classes[counting])
    table = spark.sparkContext.broadcast(learned)  # some 16 bytes for each gram of the counted labelled texts

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            f = figures(text_column(b).to_pylist(), table.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in f.T)],
                                             names=["doc_id", *FIGURES])

    measured = land(rows.mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} double" for n in FIGURES)), "toxicity")
    known = spark.createDataFrame(
        [(int(i), int(y)) for i, y, f in zip(ids, classes, folds, strict=True) if f == 3], "doc_id long, y int")
    fit = measured.join(known, "doc_id").groupBy("doc_id", "y").agg(*(F.max(n).alias(n) for n in FIGURES)).orderBy("doc_id").toPandas()
    y = fit["y"].to_numpy(float)
    if 0 < y.sum() < len(y) and any_toxic:
        *w, start = logistic(fit[FIGURES].to_numpy(), y)
        odds = F.lit(float(start))
        for n, v in zip(FIGURES, w, strict=True):
            odds = odds + F.col(n) * float(v)
        probability = 1 / (1 + F.exp(-odds))
    else:
        probability = F.lit(0.0)
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return measured.select("doc_id", held_out.alias("held_out"), probability.alias("score"), *FIGURES)


def judged(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM) -> DataFrame:
    return score(docs, labels).withColumn("predicted", (F.col("score") >= reject_from).cast("int"))
