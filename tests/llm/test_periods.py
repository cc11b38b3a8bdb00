"""Runs of words against a search that tries every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import periods
from kinweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def runs_by_hand(words):
    n, found = len(words), {}
    codes = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], codes[q:] == codes[:-q], [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi + q - lo >= max(12, 2 * q):
                found.setdefault((lo, hi + q), q)
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def by_hand(doc_id, text, change=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if change and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def fewest(f):
    """Runs from stitched fragments: of one stretch the smallest period."""
    out = {}
    for q, lo, hi in zip(*(x.tolist() for x in f)):
        if hi - lo >= max(q, 12 - q):
            out[(lo, hi + q)] = min(q, out.get((lo, hi + q), q))
    return sorted((lo, hi - lo, q) for (lo, hi), q in out.items())


def periodic_words(r):
    words = []
    for _ in range(r.randrange(1, 6)):
        part = [r.choice("abcd"[:r.randrange(1, 5)]) for _ in range(r.randrange(1, 60))]
        words += part * r.randrange(1, 9)
        words += [f"w{r.randrange(50)}" for _ in range(r.randrange(0, 20))]
    return words


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_runs_of_a_block_of_texts(seed):
    r = random.Random(seed)
    texts = [periodic_words(r) for _ in range(r.randrange(1, 5))]
    texts.append(texts[0])
    codes = [np.array([hash(w) for w in t], np.int64).view(np.uint64) for t in texts]
    for t, f in zip(texts, periods.runs_of_texts(codes), strict=True):
        assert fewest(f) == runs_by_hand(t)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([16, 32, 64]))
def test_tiles_of_a_long_text(seed, tile_words):
    words = periodic_words(random.Random(seed))
    codes = np.array([hash(w) for w in words], np.int64).view(np.uint64)
    tiles = periods.tiles_of(codes, tile_words)
    whole = periods.stitched([periods.solve_tile(**t) for t in tiles])
    assert fewest(whole) == runs_by_hand(words)
    random.Random(1).shuffle(tiles)
    assert fewest(periods.stitched([periods.solve_tile(**t) for t in tiles])) == runs_by_hand(words)


def test_query_equals_every_period(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows(QUERIES["op12_periodic_runs"](spark, SF)) == sorted((by_hand(d.doc_id, d.text) for d in docs), key=repr)


def test_odd_rows_and_small_tiles(spark, odd):
    r = random.Random(5)
    more = [(30 + i, " ".join(periodic_words(r))) for i in range(20)] + [(90, "x " * 3000), (91, "a b\tc\x0bd\n" * 40), (91, "other text"), (92, "x y " * 500)]
    docs = odd.filter("doc_id IS NULL OR doc_id NOT IN (4, 7)").unionByName(
        spark.createDataFrame([(d, t, "en", None, 1, 9, "x", 0.5) for d, t in more], odd.schema))
    want = sorted((by_hand(d.doc_id, d.text) for d in docs.collect()), key=repr)
    plain = sorted((by_hand(d.doc_id, d.text, False) for d in docs.collect()), key=repr)
    for words in (periods.TILE_WORDS, 64):
        assert rows(periods.periodic(docs, words, periods.repeated_part)) == want
        assert rows(periods.periodic(docs, words)) == plain
    assert rows(periods.periodic(docs.limit(0))) == []
    hand = sorted((d, *x) for d, t in more for x in runs_by_hand(t.split()))
    got = periods.runs(docs.filter("doc_id >= 20"), 64).collect()
    assert sorted((x.doc_id, x.start, x.length, x.period) for x in got) == hand
    longest = rows(periods.periodic(odd.filter("doc_id IN (4, 7)")))
    assert len({x[1:] for x in longest}) == 1 and longest[0][1] >= 1
