"""Operator 5: weak supervision in place of all-must-pass quality rules, in DataFrame functions.

Eight rules vote good (1), bad (-1) or abstain (0) on figures of a text. Documents with one
pattern of votes are alike, so expectation-maximisation works on counts of patterns (at most 3^8
rows, whatever the input) and estimates how often each rule votes good and bad on documents of either
kind. A document stays when its posterior probability of being good reaches
``keep_from`` and the base rules do not fail it. Texts are read once; their figures are landed.

Windows of eight words are compared by 64-bit hashes within a text. Words are runs of characters
other than ASCII white space.

Cases: a null text has no words and fails; equal rows are all judged and all count in the
estimates; very long texts are judged whole (n log n in their words); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import land

WINDOW = 8
ROUNDS = 40
KEEP_FROM = 0.5
#: name, figure f, votes bad where, votes good where (else it abstains)
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("symbols", "n_symbols / n_words", "f >= 0.4", "false"),
    ("symbol_chars", "n_symbols / word_chars", "f >= 0.08", "false"),
    ("word_length", "word_chars / n_words", "f < 2 OR f > 14", "f BETWEEN 3 AND 10"),
    ("dup_lines", "n_dup_lines / n_lines", "f >= 0.5", "false"),
    ("repeats", "n_repeat_words / n_words", "f >= 0.3", "false"),
    ("capitals", "n_capitals / word_chars", "f >= 0.3", "f BETWEEN 0.002 AND 0.1"),
    ("marks", "n_exclaims / n_words", "f >= 0.3", "false"),
    ("variety", "n_distinct / sqrt(n_words)", "f < 2", "f >= 4"),
)


def _windows(h: Column) -> Column:
    return F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(w: Column, pairs: Column, starts: Column) -> tuple[Column, Column, Column]:
    """Steps from window hashes to the number of words in repeated windows."""
    by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda x, k: x["h"] == F.get(pairs, k)["h"]
    repeated = F.array_sort(F.transform(
        F.filter(pairs, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))),
        lambda x: x["i"]))
    total = F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return by_hash, repeated, total


def figures(docs: DataFrame) -> DataFrame:
    """The base columns of every document and the further counts that the rules use."""
    t, c = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col
    x = docs.select(c("doc_id").cast("long").alias("doc_id"), t.alias("t"))
    x = x.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    x = x.withColumn("l", F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    x = x.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.transform("w", lambda s: F.xxhash64(s)).alias("h"),
    )
    x = x.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long")).withColumn("win", _windows(c("h"))).drop("h")
    pairs, starts, total = _covered(c("win"), c("pairs"), c("starts"))
    none = F.size("win") == F.size(F.array_distinct("win"))
    x = x.withColumn("pairs", F.when(~none, pairs)).drop("win")  # most texts repeat no window
    x = x.withColumn("starts", starts).drop("pairs")
    return x.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("starts")


def votes() -> list[Column]:
    out = []
    for name, figure, bad, good in RULES:
        f = f"({figure})"
        swap = lambda s, f=f: s.replace("f ", f + " ")
        out.append(F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {swap(bad)} THEN -1 WHEN {swap(good)} THEN 1 ELSE 0 END").alias(f"v_{name}"))
    return out


#: for each rule P(v | good) and P(v | bad) of v = good vote, abstention, bad vote
Rates = list[tuple[tuple[float, float, float], tuple[float, float, float]]]


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, Rates]:
    """Share of good documents and the rates at which each rule votes or abstains on either kind.

    Rates are smoothed by one document for each of the three.
    """
    share, rates = 0.8, [((0.5, 0.48, 0.02), (0.3, 0.3, 0.4))] * len(RULES)  # a bad vote is rare on good documents
    for _ in range(rounds):
        good = total = 0.0
        hits = [([1.0] * 3, [1.0] * 3) for _ in RULES]
        for vote, n in patterns:
            p = posterior(vote, share, rates)
            good += n * p
            total += n
            for (g, b), v in zip(hits, vote, strict=True):
                g[1 - v] += n * p
                b[1 - v] += n * (1 - p)
        share = (good + 1) / (total + 2)
        rates = [(tuple(x / sum(g) for x in g), tuple(x / sum(b) for x in b)) for g, b in hits]
    return share, rates


def weights(share: float, rates: Rates) -> tuple[float, list[tuple[float, ...]]]:
    """Log-odds of the share, and what a good vote, an abstention and a bad vote of each rule adds."""
    return math.log(share / (1 - share)), [tuple(math.log(x / y) for x, y in zip(g, b, strict=True)) for g, b in rates]


def posterior(vote: Sequence[int], share: float, rates: Rates) -> float:
    start, adds = weights(share, rates)
    odds = start + sum(w[1 - v] for v, w in zip(vote, adds, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, keep_from: float = KEEP_FROM, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, posterior and the votes."""
    rows = land(figures(docs).select("*", *votes()), "figures")
    names = [f"v_{r[0]}" for r in RULES]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    start, adds = weights(*estimate(sorted(patterns), rounds))
    odds = F.lit(start)
    for n, (up, none, down) in zip(names, adds, strict=True):
        odds = odds + F.when(F.col(n) > 0, up).when(F.col(n) < 0, down).otherwise(none)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("posterior"), *names,
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
