"""Repeated passages against a table of all windows in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import repeats, words
from kinweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def by_hand(docs, window=13):
    least = {}
    for d, t in docs:
        w = split(t)
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i:i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, t in docs:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_table_of_windows(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    assert rows(QUERIES["op13_substring_dedup"](spark, f"/root/testdata/{sf}")) == by_hand([(d.doc_id, d.text) for d in docs])


def test_odd_rows_small_slices_and_groups(spark, odd):
    r = random.Random(3)
    passage = " ".join(r.choice("abc") for _ in range(40))
    more = [(40 + i, " ".join(r.choice("ab") for _ in range(r.randrange(30))) + " " + passage * r.randrange(2)) for i in range(30)]
    more += [(40, passage), (40, passage), (None, passage), (99, "\t".join(["w"] * 400)), (98, "w " * 13), (97, "w " * 12)]
    docs = odd.unionByName(spark.createDataFrame([(d, t, "en", None, 1, 9, "x", 0.5) for d, t in more], odd.schema))
    plain = [(d.doc_id, d.text) for d in docs.collect()]
    want = by_hand(plain)
    assert rows(repeats.drop_repeats(docs)) == want
    assert rows(repeats.drop_repeats(docs.repartition(4), slice_bytes=500, group_bytes=200)) == want
    assert rows(repeats.drop_repeats(docs, window=5, slice_bytes=4000, group_bytes=1000)) == by_hand(plain, 5)
    assert rows(repeats.drop_repeats(docs.limit(0))) == []
    for x in repeats.drop_repeats(docs).filter("n_removed > 0").collect():
        texts = {" ".join(split(t)) for d, t in plain if d == x.doc_id}
        assert sum(s.length for s in x.spans) == x.n_removed and all(s.length >= 13 for s in x.spans)
        kept = []
        for t in texts:
            w = t.split(" ")
            for s in reversed(x.spans):
                del w[s.start:s.start + s.length]
            kept.append(" ".join(w))
        assert x.kept in kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3).map(lambda x: x << 48), max_size=60), st.integers(1, 20), st.integers(0, 2**32))
def test_groups_keep_the_order_of_prefixes(prefix, groups, seed):
    prefix = np.sort(np.array(prefix, np.uint64))
    key = np.random.default_rng(seed).integers(0, 2**64, len(prefix), np.uint64)
    order = np.lexsort((key, prefix))
    prefix, key = prefix[order], key[order]
    bounds = repeats.group_bounds(prefix, key, groups)
    got = repeats.group_of(prefix, key, bounds)
    assert (np.diff(got) >= 0).all()
    want = [sum((p, k) >= b for b in zip(*(x.tolist() for x in bounds))) for p, k in zip(prefix.tolist(), key.tolist())]
    assert got.tolist() == want
    if len(prefix) >= groups and len(np.unique(prefix)) == len(prefix) and groups > 1:
        assert np.bincount(got).max() <= -(-len(prefix) // groups) + 1


def test_long_words_and_pieces(monkeypatch):
    monkeypatch.setattr(words, "PIECE_CHARS", 7)
    texts = ["a bb  ccc\tdddddddddddddddddd e", "", " ", "x" * 30, "ñ 💡 \x85y z"]
    small = words.hashed_words(texts)
    monkeypatch.undo()
    whole = words.hashed_words(texts)
    assert (small[0] == whole[0]).all() and small[1].tolist() == whole[1].tolist() == [len(split(t)) for t in texts]
