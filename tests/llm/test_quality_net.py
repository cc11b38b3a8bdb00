"""Random indexing and the quality network: brute force, held-out accuracy, odd rows."""

import math
import re

import numpy as np

from kinweave.llm import quality_net
from kinweave.llm.bytegrams import token_hashes
from kinweave.llm.queries import QUERIES
from tests.compare import DATA
from tests.llm.conftest import CASES

TEXTS = ["A cat, a cat!! sat", "", "één | twee|drie", "  ", "x", "the the the the"]


def test_tokens_equal_those_by_hand():
    h, text = token_hashes(TEXTS)
    want = [(r, t) for r, s in enumerate(TEXTS) for t in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", s)]
    assert text.tolist() == [r for r, _ in want]
    names = {}
    assert all(names.setdefault(t, x) == x for (_, t), x in zip(want, h)) and len(set(names.values())) == len(names)


def test_contexts_and_pooling_equal_those_by_hand():
    index = quality_net.index_vectors()
    assert (index.sum(1) == 0).all() and (np.abs(index).sum(1) == 8).all()
    words, text = quality_net._places(TEXTS)
    got = quality_net.contexts(words, text, index)
    for i in range(len(words)):
        near = [j for j in range(i - 2, i + 3) if j != i and 0 <= j < len(words) and text[j] == text[i]]
        assert (got[i] == sum((index[words[j]] for j in near), np.zeros(quality_net.WIDTH))).all()
    v = np.random.default_rng(1).normal(size=index.shape).astype(np.float32)
    x = quality_net.pooled(TEXTS, v)
    w = quality_net.WIDTH
    for r in range(len(TEXTS)):
        own = words[text == r]
        assert math.isclose(x[r, -1], math.log1p(len(own)))
        assert np.allclose(x[r, :w], v[own].mean(0) if len(own) else 0, atol=1e-5)
        assert np.allclose(x[r, w:-1], (v[own[1:]] * v[own[:-1]]).mean(0) if len(own) > 1 else 0, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality_net.Network(x[:300], y[:300], x[300:1500], y[300:1500])
    p = net(x[1500:])
    late = y[1500:]
    assert net.temperature > 1  # 300 rows are learnt too well
    for lo in (0.1, 0.3, 0.5, 0.7):
        some = (p >= lo) & (p < lo + 0.2)
        assert abs(late[some].mean() - p[some].mean()) < 0.12


def test_held_out_accuracy(spark):
    folder = DATA.format("0.1")
    rows = QUERIES["op3_quality_net"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    by = {r.doc_id: r for r in rows}
    known = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if by[r.doc_id].held_out]
    assert sum(by[r.doc_id].predicted == r.quality for r in known) / len(known) > 0.98
    good = [by[r.doc_id].predicted for r in known if r.quality]
    assert sum(good) / len(good) > 0.98


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (7, 1), (None, 1)], "doc_id long, quality int")
    rows = quality_net.judged(odd, labels).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(c[0]) for c in CASES)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    empty = quality_net.judged(odd.limit(0), labels.limit(0))
    assert empty.count() == 0
    assert {r.score for r in quality_net.judged(odd, labels.limit(0)).collect()} == {1.0}
