"""Kneser-Ney toxicity: brute-force probabilities, held-out accuracy, odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinweave.llm import toxicity
from kinweave.llm.bytegrams import parts, word_grams, word_hashes
from kinweave.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.conftest import CASES

TEXTS = ["The cat sat.", "", "l'été  à\nMÜNCHEN 12", "x" * 50, "cat cats catsup"]


def grams_by_hand(text, k):
    raw = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in b" " + text.encode() + b" ")
    out = []
    for i in range(1, len(raw)):
        if raw[i] == 32 and raw[i - 1] == 32:
            continue
        start = raw.rindex(b" ", 0, i)
        out.append(raw[max(start, i + 1 - k):i + 1])
    return out


def test_grams_equal_those_by_hand():
    for k in (3, 6, 8):
        g, text, ends = word_grams(TEXTS, k)
        want = [(row, x) for row, t in enumerate(TEXTS) for x in grams_by_hand(t, k)]
        assert [(int(r), int(x).to_bytes(8, "big").lstrip(b"\0")) for r, x in zip(text, g)] == want
        assert [bool(e) for e in ends] == [x[-1:] == b" " for _, x in want]


def test_words_hash_alike_wherever_they_stand():
    h, text = word_hashes(["A bb  c\x0bbb", "", "bb\n", "abb ébb"])
    assert text.tolist() == [0, 0, 0, 0, 2, 3, 3]
    assert h[1] == h[3] == h[4] and len(set(h.tolist())) == 5
    words = [f"{a}{b}{c}" for a in "abé" for b in "xyz" for c in "1234"]
    h, _ = word_hashes([" ".join(words), "pad " + "  ".join(words)])
    assert len(set(h.tolist())) == len(words) + 1 and h[:len(words)].tolist() == h[len(words) + 1:].tolist()


def test_long_texts_are_cut_at_spaces():
    texts = ["ab cd " * 40, "", "y" * 33, "z"]
    got = defaultdict(str)
    for rows, some in parts(texts, 16):
        for r, t in zip(rows, some):
            got[r] += t
            assert len(t) <= 16
    assert [got[i] for i in range(4)] == texts


def ratios_by_hand(everything, ordinary, toxic):
    """The ratio of every gram from sets of types and counts."""
    d, top, mid, low = toxicity.DISCOUNT, *(toxicity.TOP, toxicity.MIDDLE, toxicity.LOW)
    count = lambda ts: Counter(g for t in ts for g in grams_by_hand(t, top))
    types = set(count(everything))
    middles = {g[-mid:] for g in types}
    lows = {g[-low:] for g in middles}

    def level(n, lower):
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += c > 0
        return lambda g: (max(n.get(g, 0) - d, 0) + d * kinds[g[:-1]] * lower(g)) / total[g[:-1]] if total[g[:-1]] else lower(g)

    ones = Counter(g[-1] for g in lows)
    p1 = lambda g: (ones[g[-1]] + 0.1) / (sum(ones.values()) + 25.6)
    p2 = level(Counter(g[-low:] for g in middles), lambda g: p1(g))
    p4 = level(Counter(g[-mid:] for g in types), lambda g: p2(g[-low:]))
    a, b = (level(count(x), lambda g: p4(g[-mid:])) for x in (ordinary, toxic))
    return {g: math.log(b(g)) - math.log(a(g)) for g in types}


def test_ratios_equal_those_by_hand():
    everything = ["the cat sat on the mat", "you vile rat", "a vile cat", "nothing here", "été"]
    ordinary, toxic = everything[:1] + everything[3:4], everything[1:3]
    want = ratios_by_hand(everything, ordinary, toxic)
    grams = np.array(sorted(int.from_bytes(g, "big") for g in want), np.uint64)
    key = lambda ts: Counter(int.from_bytes(g, "big") for t in ts for g in grams_by_hand(t, toxicity.TOP))
    counts = [np.array([key(ts)[int(g)] for g in grams]) for ts in (ordinary, toxic)]
    place = toxicity.places(grams)
    table = toxicity.ratios(place, grams, *counts)
    for g, p in zip(grams, place):
        assert math.isclose(table[p], want[int(g).to_bytes(8, "big").lstrip(b"\0")], abs_tol=1e-5)


def test_grams_of_many_documents_are_counted_exactly(spark):
    """More grams than any table of 2**21 places tells apart, in two scripts; every labelled one by hand."""
    rng = np.random.default_rng(8)
    filler = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 4))) + " " + "".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
    texts = ["the cat sat on the mat", "you vile rat", "a vile cat", "nothing here", "idiot été", *filler, "vilest idiots cats"]
    ids, classes = np.arange(5), np.array([0, 1, 1, 0, 1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    table, any_toxic = toxicity.model(docs, ids, classes)
    want = ratios_by_hand(texts, [texts[i] for i in ids[classes == 0]], [texts[i] for i in ids[classes == 1]])
    grams = np.array([int.from_bytes(g, "big") for g in want], np.uint64)
    assert any_toxic and np.allclose(table[toxicity.places(grams)], list(want.values()), atol=1e-5)


def test_grams_that_share_a_hash_place_keep_their_counts():
    """Two grams with one place among 2**21 used to be counted as one of them."""
    grams = np.arange(1 << 24, (1 << 24) + 20_000, dtype=np.uint64)
    place = toxicity.mixed(grams) >> np.uint64(43)
    _, first, n = np.unique(place, return_index=True, return_counts=True)
    a = grams[first[n > 1][0]]
    b = next(g for g, p in zip(grams, place) if p == place[first[n > 1][0]] and g != a)
    assert len(set(toxicity.places(np.array([a, b])).tolist())) == 2


def test_what_a_task_sends_early_adds_up():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4]), pa.array(TEXTS)], names=["doc_id", "text"])
    sums = []
    for held in (1, 1 << 20):
        total = Counter()
        for out in toxicity._count(np.array([0, 4]), np.array([0, 1]), held)(iter([batch, batch])):
            for g, o, t in zip(*(c.to_pylist() for c in out.columns)):
                total[g, "o"] += o
                total[g, "t"] += t
        sums.append(total)
    assert sums[0] == sums[1]
    assert {(int(g) % (1 << 64)).to_bytes(8, "big").lstrip(b"\0") for g, _ in sums[0]} == {g for t in TEXTS for g in grams_by_hand(t, toxicity.TOP)}
    assert sums[0][int.from_bytes(b" cat ", "big"), "t"] == 2


def planted(spark, n=1200):
    """Documents of random words; every seventh holds an abusive one."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdeiklmnoprstu"), rng.integers(2, 7))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        ws, bad = list(rng.choice(words, rng.integers(15, 90))), i % 7 == 0
        if bad:
            ws[len(ws) // 2] = "zwarx" + str(rng.choice(words))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = planted(spark)
    return docs, labels, {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}


def test_held_out_accuracy_on_planted_words(judged):
    _, labels, rows = judged
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    assert {i for i, r in rows.items() if r.held_out} == {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(p == y for p, y in held) / len(held) > 0.98


def test_held_out_labels_and_partitions_do_not_matter(spark, judged):
    docs, labels, rows = judged
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.fold(toxicity.F.col("doc_id")) == 2, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(3), flipped).collect()}
    assert all(math.isclose(again[i], r.score, abs_tol=1e-6) for i, r in rows.items())


def figures_by_hand(text, ratio):
    words, word = [], []
    for g in grams_by_hand(text, toxicity.TOP):
        word.append(ratio(g))
        if g[-1:] == b" ":
            words.append(word)
            word = []
    letters = [r for w in words for r in w]
    return [sum(letters) / max(len(letters), 1), math.log1p(sum(max(sum(w) - toxicity.TELLING, 0) for w in words)), math.log1p(len(words))]


def test_figures_equal_those_by_hand():
    everything = ["the cat sat on the mat", "you vile, vile rat", "a vile cat", "nothing here", "", "...", "été " * 3, "vilest vile " * 30]
    by_gram = ratios_by_hand(everything, [everything[0], everything[3]], everything[1:3])
    grams = np.array([int.from_bytes(g, "big") for g in by_gram], np.uint64)
    table = toxicity.Ratios(grams, np.array(list(by_gram.values())))
    want = [figures_by_hand(t, by_gram.__getitem__) for t in everything]
    assert np.allclose(toxicity.figures(everything, table), want, atol=1e-5)
    assert want[-1][1] > want[1][1] > 0 and want[4] == want[5] == [0, 0, 0]


def test_held_out_recall_in_each_language(spark):
    folder = DATA.format("0.1")
    rows = QUERIES["op8_toxicity"](spark, folder)
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    known = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    found = defaultdict(list)
    for r in known:
        if r.toxic:
            found[r.lang].append(r.predicted)
    clean = [r.predicted for r in known if not r.toxic]
    assert sum(map(sum, found.values())) >= 0.9 * sum(map(len, found.values())) and sum(clean) / len(clean) < 0.03
    assert set(found) == {"en", "fr", "de", "es"} and all(sum(x) >= 0.8 * len(x) for x in found.values()), found


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.judged(odd, labels).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(c[0]) for c in CASES)
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.judged(odd.limit(0), labels.limit(0)).count() == 0
