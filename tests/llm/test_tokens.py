"""Token files and packing: exact round trips and brute force."""

import glob
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import packing, token_files
from kinweave.llm.encode import Encoder
from kinweave.llm.queries import QUERIES, VOCABULARY
from kinweave.session import new_folder

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
ENCODER = Encoder(VOCABULARY)
PLAIN = Encoder(VOCABULARY, special=False, held=20)


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x1c\x85\xa0　᠎ab'sé|.,1ñ٣") | st.characters(codec="utf-8"), max_size=40), max_size=3))
def test_encoder_equals_library(texts):
    want = [np.array(LIB.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ENCODER.encode(texts)) == want
    texts = [f" {t} a<|endoftext|> b" for t in texts]
    want = [np.array(PLAIN.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(PLAIN.encode(texts)) == want


def test_columns_of_odd_units_spaces_and_contractions():
    r = np.random.default_rng(4)
    bits = ["a", "é", "×", "中", "’", "¿", " ", " ", "\n", "'s", "'re", "'", "\t", "\xa0", "\u2003", "1", ".", "<|", "<|endoftext|>", "\x85", "😀"]
    texts = ["".join(r.choice(bits, n)) for n in r.integers(0, 12, 4000)]
    encoder, end = Encoder(VOCABULARY, held=500), np.array([2], "<u4").tobytes()
    for lo in range(0, 4000, 400):
        ids, ends = encoder.encode_column(pa.array(texts, pa.large_string()).slice(lo, 400), end)
        want = [ids_of(t) for t in texts[lo:lo + 400]]
        assert ids.tolist() == [i for x in want for i in x]
        assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    broken = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, 3])), pa.py_buffer(b"a\xffb")])
    with pytest.raises(ValueError):
        encoder.encode_column(broken)


def test_known_words_cost_less_than_a_list_of_them():
    """Words that were met before are not made objects one by one, which alone takes as long as ``findall``."""
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts *= -(-8_000_000 // sum(map(len, texts)))
    word = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]")
    list(ENCODER.encode(texts))

    def seconds(work):
        begin = time.process_time()
        work()
        return time.process_time() - begin

    listed = min(seconds(lambda: [word.findall(t) for t in texts]) for _ in range(3))
    assert min(seconds(lambda: list(ENCODER.encode(texts))) for _ in range(3)) < listed


CASES = [(3, "b c"), (1, None), (2, ""), (None, "x"), (3, "b c"), (9, "word " * 3000), (7, "<|endoftext|> a  \n b ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", 1, "u") for d, t in CASES], "doc_id long, text string, lang string, rank int, ids string")


def test_digest_of_all_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, []
    for d, t in docs:
        ids = ids_of(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op1_token_files"](spark, SF).collect())) == want


def test_token_files_odd_rows_and_selective_reads(spark, odd):
    path = new_folder(spark, "t")
    token_files.write_tokens(odd, path, VOCABULARY)
    rows = token_files.read_tokens(spark, path).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((d or -1, ids_of(t)) for d, t in CASES)
    assert sorted(r.start for r in rows) == list(np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1])
    assert [r.doc_id for r in token_files.read_tokens(spark, path, 7, 8).collect()] == [7]
    meta = token_files.read_tokens(spark, path).select("doc_id", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    file = next(f for f in glob.glob(f"{path}/tokens/*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DELTA_BINARY_PACKED" in e for e in kinds["doc_id"].encodings)
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings)
    assert all(c.has_offset_index and c.has_column_index for n, c in kinds.items() if n == "doc_id")


def test_token_files_of_nothing(spark, odd):
    path = new_folder(spark, "t")
    token_files.write_tokens(odd.limit(0), path, VOCABULARY)
    assert token_files.digest(token_files.read_tokens(spark, path)).count() == 0


def held(rows, capacity=1024):
    """Sequences are gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    return len(by)


def test_packing_of_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == docs.keys()
    total = 0
    for d, parts in by.items():
        ids, end = ids_of(docs[d]), 0
        total += len(ids)
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, end) and (k == 0 or r.length == 1024)
            end += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:end], "<u4").tobytes())
        assert end == len(ids) and len(parts) == -(-len(ids) // 1024)
    n = held(rows)
    assert n <= 1.02 * -(-total // 1024) + 1


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, VOCABULARY).collect()
    assert held(rows) == -(-sum(len(ids_of(t)) for _, t in CASES) // 1024)
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 60)), max_size=25))
def test_plan_is_best_fit_decreasing(items):
    counts = defaultdict(int)
    for n, c in items:
        counts[n] += c
    slots, made = packing.plan(counts, 30)
    bins, ranks = defaultdict(list), defaultdict(list)
    for n, first, c, seq, at in slots:
        ranks[n] += range(first, first + c)
        for k in range(c):
            bins[seq + k].append((at, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 30 and sum(n > 10 for _, n in places) <= 2
    gaps = []  # brute force: one item at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((30 if fit is None else fit) - n)
    assert made == len(bins) == len(gaps)
