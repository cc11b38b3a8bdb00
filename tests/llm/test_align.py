"""Alignment of two tokenizers against plain loops; products of sparse matrices against dense ones."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import align, csr
from kinweave.llm.queries import PIECES, QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
A_RAW, B_RAW = align.byte_level_bytes(VOCABULARY), align.piece_bytes(B)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    same = b"".join(A_RAW[i] for i in a) == want and b"".join(B_RAW[i] for i in b) == want
    return (a, b) if same else ([], [])


def by_hand(docs):
    found, pairs = [], Counter()
    for doc_id, text in docs:
        a, b = tokens(text)
        spans = []
        for ids, raw in ((a, A_RAW), (b, B_RAW)):
            ends = np.cumsum([len(raw[i]) for i in ids]).tolist()
            spans.append(list(zip(ids, [0, *ends[:-1]], ends)))
        of_byte = [[i for i, (_, lo, hi) in enumerate(side) for _ in range(lo, hi)] for side in spans]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*of_byte)))]
        cuts = {x[2] for x in spans[0]} & {x[2] for x in spans[1]}
        written = []
        for side in spans:
            written.append([[]])
            for i, _, end in side:
                written[-1][-1].append(str(i))
                if end in cuts:
                    written[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*written) if x]
        pairs.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, j), n in pairs.items():
        best[j] = max(best[j], n)
    return sorted(
        ((d, na, nb, g, len(x), sum(pairs[p] == best[p[1]] for p in x), sum(pairs[p] for p in x), h) for d, na, nb, g, x, h in found), key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32 - 1))
def test_row_products_equal_dense(n, m, k, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(0, 3, (n, m)) * r.integers(0, 2, (n, m)), r.integers(0, 3, (m, k)) * r.integers(0, 2, (m, k))

    def sparse(d):
        i, j = np.nonzero(d)
        return csr.Csr(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(d)))]).astype(np.int64), j.astype(np.int64), d[i, j], d.shape[1])

    def dense(s):
        out = np.zeros((len(s.starts) - 1, s.width), np.int64)
        out[csr.rows_of(s), s.columns] = s.values
        return out

    a, b = sparse(x), sparse(y)
    assert (dense(csr.row_products(a, b)) == x @ y).all()
    assert (dense(csr.transposed(b)) == y.T).all()
    whole = [dense(csr.row_products(part, b)) for _, part in csr.blocks_of_rows(a, b, 2)]
    assert (np.concatenate([np.zeros((0, k), np.int64), *whole]) == x @ y).all()


def test_query_equals_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(QUERIES["op11_alignment"](spark, SF)) == by_hand(docs)


def test_odd_rows_and_small_slices(spark, odd):
    more = [(20, "x▁y"), (21, "a <|endoftext|> b"), (22, "tab\there\n\n\nend "), (23, " 💡💡 日本語 text"), (24, "x\x00y <0x0A> <s>"), (20, "x▁y")]
    extra = spark.createDataFrame([(d, t, "en", None, 1, 9, "x", 0.5) for d, t in more], odd.schema)
    docs = odd.unionByName(extra)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(align.alignment(docs, VOCABULARY, PIECES)) == want
    assert rows(align.alignment(docs.repartition(3), VOCABULARY, PIECES, slice_bytes=1)) == want
    assert rows(align.alignment(docs.limit(0), VOCABULARY, PIECES)) == []


@pytest.mark.parametrize("kind", ["overlap", "group"])
def test_links_as_rows(spark, kind):
    text = "  naïve tokenisation\nof 💡 words"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "ab")], "doc_id long, text string")
    got = Counter((r.doc_id, r.a_place, r.b_place, r.a_id, r.b_id) for r in align.links(docs, VOCABULARY, PIECES, kind).collect())
    want = Counter()
    for d, t in ((1, text), (3, "ab")):
        a, b = tokens(t)
        ea, eb = (np.cumsum([len(raw[i]) for i in ids]) for ids, raw in ((a, A_RAW), (b, B_RAW)))
        cuts = np.intersect1d(ea, eb)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if kind == "overlap":
                    near = ea[i] - len(A_RAW[x]) < eb[j] and eb[j] - len(B_RAW[y]) < ea[i]
                else:
                    near = np.searchsorted(cuts, ea[i]) == np.searchsorted(cuts, eb[j])
                if near:
                    want[(d, i, j, x, y)] += 1
    assert got == want
