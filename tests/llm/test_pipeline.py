"""The pipeline's stages against brute force, one after the other."""

from collections import Counter, defaultdict

import corpus_pipeline
from kinweave.llm import line_dedup, mixing, toxicity
from kinweave.llm.common import table
from kinweave.llm.queries import QUERIES
from kinweave.session import new_folder
from tests.compare import DATA
from tests.llm.test_near_dups import groups_by_hand
from tests.llm.test_rules_lines_urls_mixing import lines_by_hand
from tests.llm.test_tokens import held, ids_of

SF = DATA.format("0.001")


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
        path = new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name == "toxicity":
            judged = toxicity.judged(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in judged if not r.predicted}
            assert all(before[r.doc_id] == r for r in rows)
        elif name == "line_dedup":
            want = lines_by_hand([(r.doc_id, r.text) for r in before.values()], 40, 5)
            got = line_dedup.drop_common_lines(spark.createDataFrame(list(before.values()), out.schema))
            assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == want
            assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in got.collect()}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id].text)
        elif name == "near_duplicates":
            want = {c for _, c, _ in groups_by_hand([(r.doc_id, r.text) for r in before.values()])}
            assert {r.doc_id for r in rows} == want and all(before[r.doc_id] == r for r in rows)
        elif name == "mixing":
            assert {r.doc_id: r for r in rows} == before
        else:
            assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) for r in before.values())
            assert {r.doc_id for r in rows} == before.keys()
            held(rows)
    assert sorted(map(tuple, QUERIES["pipeline"](spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        tuple(r)[:5] for r in rows)


def test_stages_stand_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (frame is docs)


def test_sequences_follow_the_mixture(spark):
    sources = ["src0"] * 600 + ["src1"] * 240 + ["src19"] * 60  # weights 20, 8, 2: all end together
    docs = spark.createDataFrame(
        [(i, f"{s} " + " ".join(f"w{i} {k}" for k in range(10 + i * 7 % 120)), "en", s, 0) for i, s in enumerate(sources)],
        "doc_id long, text string, lang string, source string, n_chars long").coalesce(3)
    of, packed = dict(enumerate(sources)), {}
    for mixed in (False, True):
        path = new_folder(spark, "order")
        (corpus_pipeline.mix_sources(spark, docs, SF) if mixed else docs).write.parquet(path)
        packed[mixed] = corpus_pipeline.pack_sequences(spark, spark.read.parquet(path), SF).collect()
        held(packed[mixed])
    pieces = [{(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed[m]} for m in (False, True)]
    assert pieces[0] == pieces[1]
    assert len({r.sequence_id for r in packed[True]}) == len({r.sequence_id for r in packed[False]})
    assert {(r.doc_id, r.sequence_id) for r in packed[False]} != {(r.doc_id, r.sequence_id) for r in packed[True]}
    place = {r.doc_id: r.place for r in mixing.written_order(spark.read.parquet(path)).collect()}
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert sorted(place, key=place.get) == want
    by = defaultdict(list)
    for r in packed[True]:
        by[r.sequence_id].append((place[r.doc_id], r.piece))
    assert sorted(by) == list(range(len(by))) and sorted(by, key=lambda s: min(by[s])) == sorted(by)
    far = {}
    for mixed, rows in packed.items():
        fifths = [Counter(of[r.doc_id] for r in rows if r.sequence_id * 5 // len(by) == k) for k in range(5)]
        far[mixed] = max(abs(n[s] / n.total() - w / 30) for n in fifths for s, w in (("src0", 20), ("src1", 8), ("src19", 2)))
    assert far[True] < 0.12 < 0.5 < far[False], far
