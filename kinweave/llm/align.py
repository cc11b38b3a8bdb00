"""Operator 11: which tokens of two tokenizers cover the same bytes, and how firmly their ids belong together.

Both encodings of a text cover the same bytes. Tokens by bytes are incidence matrices A and B in compressed
rows (``csr``), the documents of a block one after the other along both sides; row products A·Bᵀ give the
overlap links with their shared bytes. Bytes where tokens of both sides end cut the tokens into groups; tokens
by groups are incidence matrices as well, and their product holds the links of tokens that share a group.

Corpus-wide counts of id pairs: texts are worked on in slices of bounded bytes. A slice lists its distinct
pairs with their counts, and its documents name pairs by their place in that list. The lists are added up,
and each slice gets the totals of its own pairs back: a pair travels at most once for each slice, however
often it occurs, so no frequent pair gathers in one task, and no table of all pairs is sent to the tasks.

Cases: null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have no
tokens: zeros and an empty string. Equal rows and repeated or null doc_ids give a row each and count each time;
a very long text is worked on alone and whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import land, text_column, text_slices
from kinweave.llm.csr import Csr, blocks_of_rows, expanded, members, row_products, rows_of, spans, transposed
from kinweave.llm.encode import Encoder, tokenizer_file

SLICE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
WORDS_HELD = 300_000  # entries of the first side's memo of words
DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
       ("n_shared", pa.int64()), ("groups_sha256", pa.string())]
DOC_SPARK = "doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_shared:long,groups_sha256:string"
SLICE_SCHEMA = f"slice long, pairs array<long>, counts array<long>, docs array<struct<{DOC_SPARK}>>, codes binary"
OUT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
              "n_shared long")


def byte_level_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id: byte-level vocabularies write bytes as printable characters."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        model = json.load(f)
    entries = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
    out = [b""] * (1 + max(entries.values()))
    for word, i in entries.items():
        out[i] = bytes(byte_of[c] for c in word)
    return out


def piece_bytes(library) -> list[bytes]:
    """The bytes of each piece; control pieces and the unknown piece have none."""
    out = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(b"" if library.is_control(i) or library.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Aligned(NamedTuple):
    """A block of texts: ids of both sides, where each text's tokens begin, links, and the group of each token."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    links: Csr
    a_group: np.ndarray
    b_group: np.ndarray
    group_starts: np.ndarray


class Aligner:
    """Both tokenizers, the bytes of their ids, and the texts of their ids with the marks that can follow."""

    def __init__(self, a_vocabulary: str, b_model: str, held: int = WORDS_HELD) -> None:
        import sentencepiece

        self.a_raw = byte_level_bytes(a_vocabulary)
        self.a = Encoder(a_vocabulary, special=False, held=held)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(b_model))
        self.b_raw = piece_bytes(self.b)
        self.a_bytes = np.array(self.a_raw, object)
        self.a_length = np.array([len(x) for x in self.a_raw], np.int32)
        self.b_length = np.array([len(x) for x in self.b_raw], np.int32)
        self.shift = len(self.b_raw).bit_length()
        na, nb = len(self.a_raw), len(self.b_raw)
        self.tables = np.array([f"{i}{mark}".encode() for n, marks in ((na, ",|"), (nb, ",;")) for mark in marks for i in range(n)]
                               + [str(i).encode() for i in range(nb)], object)
        self.bases = (0, na, 2 * na, 2 * na + nb, 2 * na + 2 * nb)  # a, | b, ; and b at the end of a text

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides for each text with a space before it; none where a side does not give it back."""
        a = list(self.a.encode([" " + t if t else "" for t in texts]))
        b = self.b.encode(texts, num_threads=1)
        raw_a, raw_b = self.a_bytes, self.b_raw.__getitem__
        for i, t in enumerate(texts):
            want = b" " + t.encode() if t else b""
            if b"".join(raw_a[np.frombuffer(a[i], "<u4")].tolist()) == want == b"".join(map(raw_b, b[i])):
                b[i] = array("I", b[i]).tobytes()
            else:
                a[i] = b[i] = b""
        return a, b

    def align(self, texts: list[str]) -> Aligned:
        a_ids, b_ids = self.encode(texts)
        starts = [np.concatenate([[0], np.cumsum([len(x) // 4 for x in side])]).astype(np.int64) for side in (a_ids, b_ids)]
        a, b = (np.frombuffer(b"".join(side), "<u4") for side in (a_ids, b_ids))
        la, lb = self.a_length[a], self.b_length[b]
        links = row_products(spans(la), transposed(spans(lb)))
        a_ends, b_ends = np.cumsum(la, dtype=np.int64), np.cumsum(lb, dtype=np.int64)
        ends = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.int8)
        ends[a_ends] = 1
        ends[b_ends] += 1
        cut_a, cut_b = ends[a_ends] == 2, ends[b_ends] == 2
        before_a, before_b = np.cumsum(cut_a), np.cumsum(cut_b)
        groups = np.concatenate([[0], before_a])[starts[0]]
        return Aligned(a, b, *starts, links, before_a - cut_a, before_b - cut_b, groups)

    def shared(self, x: Aligned) -> tuple[Csr, Csr]:
        """Tokens by groups of the first side, and groups by tokens of the second; their product links groups."""
        n = int(x.group_starts[-1])
        return members(x.a_group, n), transposed(members(x.b_group, n))

    def digests(self, x: Aligned) -> list[str]:
        """For each text the hash of its groups in writing."""
        n = int(x.group_starts[-1])
        a_ends = np.cumsum(np.bincount(x.a_group, minlength=n)) if n else np.zeros(0, np.int64)
        b_ends = np.cumsum(np.bincount(x.b_group, minlength=n)) if n else np.zeros(0, np.int64)
        which = np.empty(len(x.a) + len(x.b), np.int64)
        mark = np.zeros(len(x.a), np.int64)
        mark[a_ends - 1] = 1
        at = np.arange(len(x.a)) + np.concatenate([[0], b_ends])[x.a_group]
        which[at] = x.a + np.array(self.bases[:2])[mark]
        mark = np.zeros(len(x.b), np.int64)
        mark[b_ends - 1] = 1
        mark[x.b_starts[1:][np.diff(x.b_starts) > 0] - 1] = 2
        at = np.arange(len(x.b)) + a_ends[x.b_group] if n else np.zeros(0, np.int64)
        which[at] = x.b + np.array(self.bases[2:])[mark]
        words = self.tables[which].tolist()
        both = (x.a_starts + x.b_starts).tolist()
        return [hashlib.sha256(b"".join(words[lo:hi])).hexdigest() if hi > lo else "" for lo, hi in zip(both[:-1], both[1:], strict=True)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_vocabulary: str, b_model: str) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    key = (a_vocabulary, b_model)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _slices(a_vocabulary: str, b_model: str, slice_bytes: int):
    """Documents in blocks with their figures and the places of their pairs; then the slice's list of pairs."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_vocabulary, b_model)
        pack = zstandard.ZstdCompressor(level=1)
        part, number = TaskContext.get().partitionId(), 0
        docs: list[pa.StructArray] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []  # distinct pairs of a block, and the place of each link's among them
        size = 0

        def flush() -> pa.RecordBatch:
            known = np.unique(np.concatenate([own for own, _ in pairs]))
            counts = np.zeros(len(known), np.int64)
            blobs = []
            for own, codes in pairs:
                places = np.searchsorted(known, own)
                counts[places] += np.bincount(codes, minlength=len(own))
                blobs.append(pack.compress(places[codes].astype("<u4").tobytes()))
            n = len(docs)
            offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            first = [len(known), *[0] * n]  # the list of pairs is a row of its own, before the blocks
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(n + 1, (part << 32) + number, np.int64)),
                pa.ListArray.from_arrays(offsets(first), pa.array(known)),
                pa.ListArray.from_arrays(offsets(first), pa.array(counts)),
                pa.ListArray.from_arrays(offsets([0, *(len(d) for d in docs)]), pa.concat_arrays(docs)),
                pa.array([None, *blobs], pa.binary()),
            ], names=["slice", "pairs", "counts", "docs", "codes"])

        for b in text_slices(batches, BLOCK_BYTES):
            texts = text_column(b).to_pylist()
            x = al.align(texts)
            pair = (x.a[rows_of(x.links)].astype(np.int64) << al.shift) | x.b[x.links.columns].astype(np.int64)
            own, codes = np.unique(pair, return_inverse=True)
            pairs.append((own, codes.astype(np.uint32)))
            n_shared = np.concatenate([[0], np.cumsum(expanded(*al.shared(x)))])[x.a_starts]
            figures = [np.diff(x.a_starts), np.diff(x.b_starts), np.diff(x.group_starts), np.diff(x.links.starts[x.a_starts]), np.diff(n_shared)]
            docs.append(pa.StructArray.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(f.astype(np.int64)) for f in figures), pa.array(al.digests(x), pa.string())],
                fields=[pa.field(*f) for f in DOC]))
            size += sum(map(len, texts))
            if size >= slice_bytes:
                yield flush()
                docs, pairs, size, number = [], [], 0, number + 1
        if docs:
            yield flush()

    return solve


def _finish(key: tuple, totals: pa.Table, blocks: pa.Table) -> pa.Table:
    """Figures of one slice's documents from the totals of its pairs."""
    count = np.zeros(len(totals), np.int64)
    best = np.zeros(len(totals), np.int64)
    at = totals.column("pos").to_numpy()
    count[at] = totals.column("total").to_numpy()
    best[at] = totals.column("is_best").to_numpy()
    unpack = zstandard.ZstdDecompressor()
    out = []
    for docs, blob in zip(blocks.column("docs"), blocks.column("codes"), strict=True):
        d = docs.values
        codes = np.frombuffer(unpack.decompress(blob.as_buffer()), "<u4")
        starts = np.concatenate([[0], np.cumsum(d.field("n_links").to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[codes])])[starts]) for v in (best, count)]
        field = {f: d.field(f) for f, _ in DOC}
        out.append(pa.Table.from_arrays([
            *(field[f] for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), field["groups_sha256"], field["n_shared"],
        ], names=[c.split()[0] for c in OUT_SCHEMA.split(", ")]))
    return pa.concat_tables(out)


def alignment(docs: DataFrame, a_vocabulary: str, b_model: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how its links stand in the whole corpus."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = land(texts.mapInArrow(_slices(a_vocabulary, b_model, slice_bytes), SLICE_SCHEMA), "slices", compression="zstd")
    shift = len(aligner(a_vocabulary, b_model).b_raw).bit_length()
    listed = slices.filter(F.size("pairs") > 0)
    totals = land(listed.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.counts").alias("total")), "pairs")
    to_b = F.col("pair") % (1 << shift)
    highest = totals.groupBy(to_b.alias("b")).agg(F.max("total").alias("highest"))
    judged = totals.withColumn("b", to_b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("is_best"))
    answers = listed.select("slice", F.posexplode("pairs").alias("pos", "pair")).join(judged, "pair").select("slice", "pos", "total", "is_best")
    blocks = slices.filter(F.col("codes").isNotNull()).select(F.col("slice").alias("own"), "docs", "codes")
    return answers.groupBy("slice").cogroup(blocks.groupBy("own")).applyInArrow(_finish, OUT_SCHEMA)


def links(docs: DataFrame, a_vocabulary: str, b_model: str, kind: str = "overlap") -> DataFrame:
    """The links themselves: doc_id, places and ids of both tokens; ``overlap`` with shared bytes, or ``group`` links."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a_vocabulary, b_model)
        for batch in text_slices(batches, BLOCK_BYTES):
            x = al.align(text_column(batch).to_pylist())
            left, right = (spans(al.a_length[x.a]), transposed(spans(al.b_length[x.b]))) if kind == "overlap" else al.shared(x)
            ids = np.array(batch.column(0).to_pylist(), object)
            for first, rows in blocks_of_rows(left, right):
                m = row_products(rows, right)
                i, j = rows_of(m) + first, m.columns
                doc = np.searchsorted(x.a_starts, i, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[doc].tolist(), pa.int64()), pa.array(i - x.a_starts[doc]), pa.array(j - x.b_starts[doc]),
                    pa.array(x.a[i].astype(np.int64)), pa.array(x.b[j].astype(np.int64)), pa.array(m.values.astype(np.int64)),
                ], names=["doc_id", "a_place", "b_place", "a_id", "b_id", "weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(solve, "doc_id long, a_place long, b_place long, a_id long, b_id long, weight long")
