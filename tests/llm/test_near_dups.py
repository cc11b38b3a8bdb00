"""N-gram Jaccard join against all pairs by hand."""

import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from kinweave.llm import near_dups
from kinweave.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.conftest import CASES


def shingles_by_hand(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_by_hand(docs):
    """doc_id -> (class_id, n_links), from every pair that shares a shingle."""
    sets = [(i, shingles_by_hand(t)) for i, t in docs if i is not None]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    shared = Counter((a, b) for ks in holders.values() for n, b in enumerate(ks) for a in ks[:n])
    root, links = list(range(len(sets))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a][1]) + len(sets[b][1]) - n):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def answer(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect() if r.doc_id is not None)


def test_shingles_equal_those_by_hand():
    texts = [t for _, t, _ in CASES] + ["a b c d", "A b c d", "a b c d e", "a b c d e a b c d e a", "one"]
    h, row = near_dups.shingles([t or "" for t in texts])
    assert [int(n) for n in np.bincount(row, minlength=len(texts))] == [len(shingles_by_hand(t)) for t in texts]
    names = [set(h[row == k].tolist()) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(a):
            assert len(names[a] & names[b]) == len(shingles_by_hand(texts[a]) & shingles_by_hand(texts[b]))


def test_minhash_agreement_is_the_similarity():
    found = []
    for k in range(30):
        h, row = near_dups.shingles([" ".join(f"{k}w{i}" for i in range(s, s + 400)) for s in (0, 40)])
        sig = near_dups.minhash(h, np.flatnonzero(np.diff(row, prepend=-1)))
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - 356 / 436) < 0.02 and 0.02 < np.std(found) < 0.05


def test_pruning_bounds_are_the_posterior():
    for t, m in zip(range(near_dups.STEP, near_dups.VALUES + 1, near_dups.STEP), near_dups.least_matches(0.8, 1e-6)):
        xs = (np.arange(200_000) + 0.5) / 200_000
        for k, above in ((m, True), (m - 1, False)):
            density = xs ** k * (1 - xs) ** (t - k) * comb(t, k) * (t + 1)
            assert (density[xs >= 0.8].mean() * 0.2 >= 1e-6) == above


@pytest.mark.parametrize("few", [True, False])
def test_intersections(few):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000))).astype(np.uint64) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    i, j = (i[:9], j[:9]) if few else (i, j)
    assert near_dups.intersections(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{DATA.format(sf)}/documents.parquet").select("doc_id", "text").collect()
    assert answer(QUERIES["op4_near_duplicates"](spark, DATA.format(sf))) == groups_by_hand([tuple(d) for d in docs])


def test_hot_group_of_near_copies_in_blocks(spark):
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(120)]
    docs = [(1000 + i, " ".join(base[:k] + [f"new{i}"] + base[k + 1:])) for i, k in enumerate(rng.integers(0, 120, 300))]
    docs += [(5 + i, " ".join(base)) for i in range(40)] + [(3000 + i, " ".join(rng.permutation(base))) for i in range(100)]
    df = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=64)
    assert answer(df) == groups_by_hand(docs)


def test_odd_rows(spark, odd):
    df = near_dups.near_duplicates(odd)
    rows = [(d, t) for d, t, _ in CASES]
    assert answer(df) == groups_by_hand(rows)
    assert df.count() == len(CASES)
    kept = near_dups.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 3, 4, 5, 6, None])
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA.format('0.001')}/documents.parquet")
    want = {c for _, c, _ in groups_by_hand([tuple(d) for d in docs.select("doc_id", "text").collect()])}
    assert {r.doc_id for r in near_dups.keep_one(docs).collect()} == want


def test_texts_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (7, c, "x"), (7, a + " more", "x"), (9, b, "x"), (9, b, "y"), (11, "", "x"), (11, None, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in near_dups.keep_one(docs.repartition(4)).collect()]
    assert sorted((t or "" for _, t in kept), key=str) == sorted([a, a, b, c, "", ""])
    assert (3, a) in kept and (9, b) in kept and (7, c) in kept and (None, a) in kept and (11, "") in kept and (11, None) in kept
    one = [(4, a, "x"), (4, b, "x"), (4, c, "x")]
    assert near_dups.keep_one(spark.createDataFrame(one, docs.schema)).count() == 3
