"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

LONG = ("alpha beta gamma delta " * 9 + "stop. " + " ".join(f"w{i}" for i in range(4000)) + "\n") * 12
CASES = [
    (1, None, "src0"), (2, "", None), (None, "a lone line without a document id that is long enough", "src0"),
    (3, "same text", "src1"), (3, "same text", "src1"), (4, LONG, "src0"), (5, "  \t\n\r\x0b \n", "srcX"),
    (6, "ñandú ÉTÉ 💡 ß\nñandú", "src2"), (7, LONG, "src0"), (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en", s, 1, 9, "x", 0.5) for d, t, s in CASES]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, n_lines string, score double")
