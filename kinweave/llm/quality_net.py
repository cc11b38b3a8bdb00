"""Operator 3: text quality from random-indexing word vectors and a two-layer network.

Each word place (words are hashed to a fixed number of places) has a sparse random index vector;
its word vector is the sum of the index vectors of the words around it in all documents, labelled
or not. A document is the mean of its word vectors, the mean of the products of the vectors of
neighbouring words (which tells repeated words), and its length. A two-layer network in numpy, with
a temperature fitted on texts it has not learnt from, turns that into a probability.

Every task adds up its own table of word vectors and sends the places it has met; the table is of
bounded size wherever it is held. Labels are taken from at most ``fit_rows`` labelled rows (all up
to that bound, else those with the smallest hashes of their ids). Pooled vectors are landed once and
both fit and scoring read them.

Cases: null and empty texts have a pooled vector of zeros and a score like all others; equal rows
get equal scores; a null doc_id is scored and never held out; without labels of both kinds every
score is 1 (nothing is rejected); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bytegrams import parts, token_hashes
from kinweave.llm.common import FIT_ROWS, fold, ids_of, land, sample, text_column, text_slices

PLACES = 1 << 14
WIDTH = 32
AROUND = 2  # words before and after
BLOCKS = 32
HIDDEN = 24
GOOD_FROM = 0.7


def index_vectors() -> np.ndarray:
    """Four entries of +1 and four of -1 in each row; the same on every machine."""
    rng = np.random.default_rng(20240229)
    order = np.argsort(rng.random((PLACES, WIDTH)), axis=1)
    out = np.zeros((PLACES, WIDTH), np.int32)
    np.put_along_axis(out, order[:, :4], 1, 1)
    np.put_along_axis(out, order[:, 4:8], -1, 1)
    return out


def _places(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    h, text = token_hashes(texts)
    return (h >> np.uint64(50)).astype(np.uint16), text


def contexts(words: np.ndarray, text: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of the words around it in the same text."""
    out = np.zeros((len(words), WIDTH), np.int32)
    for step in range(1, AROUND + 1):
        same = (text[step:] == text[:-step])[:, None]
        out[step:] += np.where(same, index[words[:-step]], 0)
        out[:-step] += np.where(same, index[words[step:]], 0)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total, met = index_vectors(), np.zeros((PLACES, WIDTH), np.int64), np.zeros(PLACES, np.int64)
    for b in text_slices(batches):
        for _, texts in parts(text_column(b).to_pylist(), 1 << 19):
            words, text = _places(texts)
            if not len(words):
                continue
            order = np.argsort(words, kind="stable")
            new = np.flatnonzero(np.diff(words[order], prepend=-1))
            total[words[order[new]]] += np.add.reduceat(contexts(words, text, index)[order], new, dtype=np.int64)
            met += np.bincount(words, minlength=PLACES)
    yield from _blocks(total, met)


def _blocks(total: np.ndarray, met: np.ndarray, only: Sequence[int] = range(BLOCKS)) -> Iterator[pa.RecordBatch]:
    size = PLACES // BLOCKS
    for k in only:
        used = np.flatnonzero(met[k * size:(k + 1) * size]) + k * size
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (used, total[used], met[used]))],
                names=["block", "place", "total", "met"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, met, seen = np.zeros((PLACES, WIDTH), np.int64), np.zeros(PLACES, np.int64), set()
    for b in batches:
        for block, place, t, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
            p = np.frombuffer(place, np.int64)
            total[p] += np.frombuffer(t, np.int64).reshape(-1, WIDTH)
            met[p] += np.frombuffer(m, np.int64)
            seen.add(block)
    yield from _blocks(total, met, sorted(seen))


def word_vectors(total: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Contexts less their mean over all words, at length 1."""
    mean = total / np.maximum(met, 1)[:, None]
    mean -= total.sum(0) / max(met.sum(), 1)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(met[:, None] > 0, mean / np.maximum(norm, 1e-9), 0).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """For each text the mean word vector, the mean product of neighbours and log(1 + words)."""
    n = len(texts)
    out, words_of, pairs_of = np.zeros((n, 2 * WIDTH + 1)), np.zeros(n), np.zeros(n)
    for rows, some in parts(texts, 1 << 19):
        words, text = _places(some)
        if not len(words):
            continue
        row, v = np.array(rows)[text], vectors[words]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        np.add.at(out[:, :WIDTH], row[start], np.add.reduceat(v, start, dtype=np.float64))
        words_of += np.bincount(row, minlength=n)
        pair = v[1:] * v[:-1]
        pair[row[1:] != row[:-1]] = 0
        np.add.at(out[:, WIDTH:-1], row[start], np.add.reduceat(np.vstack([pair, np.zeros((1, WIDTH), np.float32)]), start, dtype=np.float64))
        pairs_of += np.bincount(row[1:][row[1:] == row[:-1]], minlength=n)
    out[:, :WIDTH] /= np.maximum(words_of, 1)[:, None]
    out[:, WIDTH:-1] /= np.maximum(pairs_of, 1)[:, None]
    out[:, -1] = np.log1p(words_of)
    return out


class Network:
    """Inputs to a standard scale, a hidden layer of tanh, one output, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, later_x: np.ndarray, later_y: np.ndarray,
                 rounds: int = 60, rate: float = 0.01, shrink: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                some = order[i:i + 256]
                hidden = np.tanh(x[some] @ self.w[0] + self.w[1])
                gap = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -30, 30))) - y[some]) / len(some)
                back = np.outer(gap, self.w[2]) * (1 - hidden ** 2)
                grads = [x[some].T @ back, back.sum(0), hidden.T @ gap, gap.sum(keepdims=True)]
                t += 1
                for a, g, p, q in zip(self.w, grads, m, v, strict=True):
                    g = g + shrink * a
                    p += 0.1 * (g - p)
                    q += 0.001 * (g * g - q)
                    a -= rate * (p / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-8)
        self.temperature = 1.0
        if len(later_x):
            odds = self.odds(later_x)
            spread = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(min(spread, key=lambda k: np.logaddexp(0, np.where(later_y > 0, -odds, odds) / k).mean()))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) / self.temperature

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out and score of every document; labels teach, and are no input of a score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "block int, place binary, total binary, met binary"
    found = rows.select("text").mapInArrow(_gather, schema).repartition(BLOCKS, "block").mapInArrow(_add_up, schema).toArrow()
    total, met = np.zeros((PLACES, WIDTH), np.int64), np.zeros(PLACES, np.int64)  # the table, at most PLACES rows
    for _, place, t, m in zip(*(c.to_pylist() for c in found.columns), strict=True):
        p = np.frombuffer(place, np.int64)
        total[p], met[p] = np.frombuffer(t, np.int64).reshape(-1, WIDTH), np.frombuffer(m, np.int64)
    vectors = spark.sparkContext.broadcast(word_vectors(total, met))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            x = pooled(text_column(b).to_pylist(), vectors.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "vector"])

    landed = land(rows.mapInArrow(pool, "doc_id long, vector binary"), "pooled")
    ids, classes, folds = sample(labels, "quality", fit_rows)
    known = spark.sparkContext.broadcast(ids)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.isin(ids_of(b), known.value)))

    # at most fit_rows documents of 260 bytes; rows that repeat a doc_id count once
    fit = landed.mapInArrow(labelled, landed.schema).groupBy("doc_id").agg(F.max("vector").alias("vector")).toArrow().sort_by("doc_id")
    at = np.searchsorted(ids, fit.column("doc_id").to_numpy())
    x = np.frombuffer(b"".join(fit.column("vector").to_pylist()), np.float32).reshape(-1, 2 * WIDTH + 1).astype(float)
    y, late = classes[at].astype(float), folds[at] == 3 if len(at) else np.zeros(0, bool)
    net = Network(x[~late], y[~late], x[late], y[late]) if len(set(y[~late])) == 2 else None
    model = spark.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, 2 * WIDTH + 1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value(v) if model.value else np.ones(len(v)))], names=["doc_id", "score"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return landed.mapInArrow(judge, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score")


def judged(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    return score(docs, labels).withColumn("predicted", (F.col("score") >= good_from).cast("int"))
