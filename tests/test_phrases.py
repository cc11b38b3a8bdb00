"""Phrases of a table in texts, by hand and against the compiled expression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinweave.operators import joins, phrases

BOUND = r"[\w]"


def by_hand(texts, table, longest):
    """Every place of every phrase, tried one by one."""
    out = set()
    for key, text in texts:
        low = (text or "").lower()
        starts = [m.start() for m in re.finditer(r"\w+", low)]
        hits = set()
        for phrase, label in table:
            bare = re.sub(r"^\W+|\W+$", "", phrase.lower())
            for i, at in enumerate(starts):
                end = at + len(bare)
                if bare and low.startswith(bare, at) and not re.match(r"\w", low[end:end + 1]):
                    hits.add((i, len(re.findall(r"\w+", bare)), bare, label))
        for s, n, p, label in hits:
            inside = any(t <= s and s + n <= t + m and m > n for t, m, _, _ in hits)
            if not (longest and inside):
                out.add((key, s, n, p, label))
    return out


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("width", [2, 3])
def test_every_place_by_hand(spark, longest, width):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice(["a", "b", "Ç", "d1"]) + rnd.choice([" ", " ", ", ", "\n"]) for _ in range(n))
    texts = [(i, text(rnd.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, " .. "), (103, "a " * 3000)]
    table = list({(text(rnd.randint(1, 7)), rnd.choice("XY")) for _ in range(80)}) + [("...", "X"), ("(a b!", "Z"), ("a", "X"), ("a", "Y")]
    got = phrases.phrase_hits(
        spark.createDataFrame(texts, "id long, text string"), ["id"], ["text"],
        spark.createDataFrame(table, "phrase string, label string"), longest, width).collect()
    rows = [(r["id"], r["start"], r["n_words"], r["phrase"], r["label"]) for r in got]
    assert len(rows) == len(set(rows))
    assert set(rows) == by_hand(texts, table, longest)


def test_same_rows_as_the_compiled_expression(spark):
    kw = {"chile": ["chile", "santiago de chile"], "perú": ["perú", "lima"], "cuba": ["la habana"]}
    texts = [(1, "chile", "Nació en Santiago de Chile y vivió en Lima."), (2, "perú", "Limache, La  Habana"), (3, "cuba", "LA HABANA; perú"),
             (4, None, "chilena, perú2, Chile"), (5, "x", None)]
    df = spark.createDataFrame(texts, "id long, own string, text string")
    table = spark.createDataFrame([(w, k) for k, ws in kw.items() for w in ws], "phrase string, label string")
    old = joins.dictionary_join(df, ["text"], kw, "own", word=True).select("id", "vinculo").collect()
    new = phrases.phrase_join(df, "id", "own", ["text"], table, longest=False).select("id", "vinculo").collect()
    assert sorted(old) == sorted(new) and len(new) == 3


def test_no_phrases_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "phrase string, label string")
    some = spark.createDataFrame([("a b", "X")], "phrase string, label string")
    assert phrases.phrase_hits(df, ["id"], ["text"], none).count() == 0
    assert phrases.phrase_hits(df.limit(0), ["id"], ["text"], some).count() == 0


def test_dictionary_order_decides(spark):
    df = spark.createDataFrame([(1, "b then a"), (2, "a"), (3, "c")], "id long, text string")
    table = spark.createDataFrame([("a", "A", 2), ("b", "B", 1)], "phrase string, label string, pos int")
    first = {r["id"]: r["pais"] for r in phrases.infer_by_phrases(df, "id", ["text"], table).collect()}
    lists = {r["id"]: r["conecta_con"] for r in phrases.targets_by_phrases(df, "id", ["text"], table).collect()}
    assert first == {1: "B", 2: "A"} and lists == {1: "B, A", 2: "A"}


def test_no_product_and_no_gram_text_in_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a b c d e")], "id long, text string")
    table = spark.createDataFrame([("a b c d", "X")], "phrase string, label string")
    plan = phrases.phrase_hits(df, ["id"], ["text"], table)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def shuffled_rows(spark):
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_grams_without_a_phrase_and_frequent_ones_are_not_shuffled(spark):
    rnd = random.Random(5)
    words = 100 * 400
    texts = [(i, " ".join(f"w{rnd.randrange(10**6)}" if rnd.random() < 0.7 else rnd.choice(["the", "a"]) for _ in range(400))) for i in range(100)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(4).localCheckpoint()
    table = [("the", "X"), ("the the the", "Y"), ("q r s", "Z"), ("q r", "Z")]
    before = shuffled_rows(spark)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with a dictionary that is large
    hits = phrases.phrase_hits(df, ["id"], ["text"], spark.createDataFrame(table, "phrase string, label string"), longest=False)
    got = {(r["id"], r["start"], r["n_words"], r["phrase"], r["label"]) for r in hits.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert got == by_hand(texts, table, False)
    # of the three grams of each word only the sample's are counted (once more, but for their different ones)
    assert shuffled_rows(spark) - before < 3.3 * words


@pytest.mark.parametrize("longest", [True, False])
def test_slices_of_some_texts_and_parts_of_the_dictionary(spark, longest):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["a", "b", "é", "d1"]) for _ in range(n))
    texts = [(i, text(rnd.randint(0, 30))) for i in range(80)] + [(100, None), (101, "b a " * 40)]
    table = list({(text(rnd.randint(1, 12)), rnd.choice("XYZ")) for _ in range(200)})
    got = phrases._found(spark.createDataFrame(texts, "id long, text string"), ["id"], ["text"],
                         spark.createDataFrame(table, "phrase string, label string"), longest, 4, "hits", slice_chars=60).collect()
    rows = [(r["id"], r["start"], r["n_words"], r["phrase"], r["label"]) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(texts, table, longest)


def test_a_slice_asks_once_for_each_gram(spark):
    rnd = random.Random(6)
    line = [f"w{i}" for i in range(5000)]
    texts = [(i, " ".join(rnd.sample(line, 1000))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1).localCheckpoint()
    table = spark.createDataFrame([(w, "XY"[i % 2]) for i, w in enumerate(line)], "phrase string, label string").localCheckpoint()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    before = shuffled_rows(spark)
    got = phrases.phrase_join(df.withColumn("own", F.lit("q")), "id", "own", ["text"], table).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert len(got) == 400 and sum(r["n_hits"] for r in got) == 200_000
    # 200,000 words hit one of 5,000 phrases each, none of them frequent in few texts or many
    assert shuffled_rows(spark) - before < 40_000
