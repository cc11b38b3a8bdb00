"""Operator 10: best-fit packing of documents into sequences, large items matched in pairs.

Only the number of pieces of each length (at most ``capacity`` lengths) decides the packing, so
the plan is made from that histogram and is exact at every size: pieces above a third of the
capacity are matched greedily, the largest with the largest that still fits (at most two in a
sequence); smaller ones go, longest first, into the sequence with the smallest gap that holds
them. The plan gives ranges of ranks within a length to ranges of sequences; each piece finds its
place from its rank. Ranks are counted in hash chunks, so one common length is many tasks.

With ``place``, a column of unique numbers, sequences follow that order as far as the lengths let
them: the sequences of the plan are spread evenly, pieces of each length go to them in the order
of ``place``, and sequences are numbered by the smallest place they hold. Ranks are then counted
in range chunks. Without it, the order of ``sequence_id`` says nothing.

Cases: a null text is the empty text, one piece with the end id; longer documents are cut so that
all pieces but the first are full; equal rows and equal lengths are ordered by doc_id, piece and
checksum; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import land, number_within, text_column, text_slices, with_row_index
from kinweave.llm.encode import END_ID, WORDS_HELD, encoder
from kinweave.operators.ranking import number_rows

CAPACITY = 1024
RUN = 1 << 16
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: length, first rank, pieces, first sequence, offset
Slot = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """Slots for all pieces, and the number of sequences. Work is bounded by the capacity alone."""
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] += c
    used = [0] * (capacity + 1)  # ranks given away, by length
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    slots: list[Slot] = []
    made = 0

    def put(length: int, first: int, n: int, offset: int) -> None:
        slots.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for big in range(capacity, third, -1):
        while left[big]:
            mate = next((m for m in range(min(big, capacity - big), third, -1) if left[m] > (m == big)), 0)
            n = left[big] if not mate else left[big] // 2 if mate == big else min(left[big], left[mate])
            put(big, made, n, 0)
            if mate:
                put(mate, made, n, big)
            gaps.setdefault(capacity - big - mate, []).append((made, n))
            made += n
    for small in range(third, 0, -1):
        while left[small]:
            gap = next((g for g in range(small, capacity + 1) if gaps.get(g)), 0)
            if gap:
                first, n = gaps[gap].pop()
            else:
                gap, first, n = capacity, made, -(-left[small] // (capacity // small))
                made += n
            each = gap // small
            full = min(n, left[small] // each)
            bins, each = (full, each) if full else (1, left[small])
            for k in range(each):
                put(small, first, bins, capacity - gap + k * small)
            gaps.setdefault(gap - each * small, []).append((first, bins))
            if n > bins:
                gaps.setdefault(gap, []).append((first + bins, n - bins))
    return slots, made


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, place: str | None = None,
        held: int = WORDS_HELD) -> DataFrame:
    """The pieces of each document: spans of its ids with their checksum, and its place if there is one."""
    carried = [F.col(place).cast("long").alias("place")] if place else []
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * (3 + len(carried)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["place"] * len(carried)]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(vocabulary, held), np.array([end_id], "<u4").tobytes()
        for b in text_slices(batches):
            rows, first = [], 0
            ids, ends = e.encode_column(text_column(b), end)
            raw = memoryview(ids.view(np.uint8))
            more = zip(*(c.to_pylist() for c in b.columns[2:]), strict=True) if place else repeat((), b.num_rows)
            for doc, last, rest in zip(b.column(0).to_pylist(), ends.tolist(), more, strict=True):
                n = last - first
                lo, hi, piece = 0, (n - 1) % capacity + 1, 0
                while lo < n:
                    rows.append((doc, piece, lo, hi - lo, zlib.crc32(raw[4 * (first + lo):4 * (first + hi)]), *rest))
                    lo, hi, piece = hi, hi + capacity, piece + 1
                first = last
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried).mapInArrow(
        pieces, PIECE_SCHEMA + (", place long" if place else ""))


def _in_order(rows: DataFrame, slots: list[Slot]) -> DataFrame:
    """Pieces to the slots of their length by place, sequences numbered by the smallest place they hold."""
    spark = rows.sparkSession
    runs = [(length, seq + k, min(n - k, RUN), offset) for length, _, n, seq, offset in slots for k in range(0, n, RUN)]
    seats = spark.createDataFrame(runs, "length long, seq long, n long, offset long").select(
        "length", F.explode(F.sequence("seq", F.col("seq") + F.col("n") - 1)).alias("seq"), "offset")
    spread = F.pmod(F.pmod("seq", F.lit(1 << 30)) * F.lit(2654435769), F.lit(1 << 32))  # golden ratio: every run of sequences lies evenly
    seats = number_rows(seats.withColumn("spread", spread), ["length"], ["spread", "seq", "offset"], "rank").drop("spread")
    seated = number_rows(rows, ["length"], ["place", "piece"], "rank").join(seats, ["length", "rank"])
    seated = land(seated.drop("rank"), "seated")
    first = seated.groupBy("seq").agg(F.min(F.struct("place", "piece")).alias("first"))
    ids = number_rows(first, [], ["first"], "sequence_id").select("seq", (F.col("sequence_id") - 1).alias("sequence_id"))
    return seated.join(ids, "seq").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, place: str | None = None,
         held: int = WORDS_HELD) -> DataFrame:
    """Each piece (span of its document's ids) with its sequence and its offset there; ``held`` bounds the encoder's memo."""
    rows = land(cut(docs, vocabulary, capacity, end_id, place, held), "pieces")  # texts are encoded once
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    slots, _ = plan(counts, capacity)
    if place:
        return _in_order(rows, slots)
    s = np.array(sorted(slots) or [(0, 0, 0, 0, 0)], np.int64)
    wide = s[:, 0] << 44 | s[:, 1]  # (length, rank) in one number; ranks stay below 2**44

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(wide, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(s[at, 3] + rank - s[at, 1]), pa.array(s[at, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = number_within(with_row_index(rows), "length", ["doc_id", "piece", "ids_crc32"], counts)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(
        seat, f"{PIECE_SCHEMA}, sequence_id long, offset long")
