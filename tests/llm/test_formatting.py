from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantweave.llm.formatting import copies, records, words

SAME, TEXTS = ["entry_type", "matched_id"], ["a", "b"]
SCHEMA = "id long, entry_type string, matched_id string, a string, b string, _key string, keep_id int"


def test_words():
    assert words("GT16 Straße") == words("strasse, gt 16") == ["16", "gt", "strasse"]
    assert words("1/2") != words("12")
    assert words("Bio­gas​") == ["biogas"]
    assert words("über") == words("ÜBER") and words("ue") != words("ü")
    assert words("") == words(" - ") == []


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_case_and_order_do_not_matter(text):
    if text.upper().casefold() == text.casefold():
        assert words(text.upper()) == words(text)
    assert words(" ".join(reversed(text.split()))) == words(text)


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_copies(spark, hot):
    rows = [
        (5, "x", None, "Wind Park 1/2", "B", "k", 1), (3, "x", None, "b", "park-WIND 1 2", "k", 1), (9, "x", None, "WINDPARK 1/2", "B", "k", 1), (1, "y", None, "Wind Park 1/2", "B", "k", 1),
        (7, "x", None, None, "B", None, None), (8, "x", None, None, "b", None, None), (10, None, None, None, None, None, None), (11, None, None, None, None, None, None), (12, "x", None, "", "b", None, None), (20, "x", "None", None, "B", None, None),
        *[(100 + i, "z", "1", "Nord " * (1 + i % 2) + "x" * 10, "Q", "k", 1) for i in range(8)],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in copies(df, "id", SAME, TEXTS, hot_rows=hot).collect())
    assert got == [(3, 5), (7, 8), (10, 11), (100, 102), (100, 104), (100, 106), (101, 103), (101, 105), (101, 107)]
    kept = dict(tuple(r) for r in records(df, "id", SAME, TEXTS, hot_rows=hot).collect())
    assert sum(kept.values()) == len(rows) and kept[3] == 2 and kept[100] == 4 and kept[9] == 1


def test_empty_and_long(spark):
    assert copies(spark.createDataFrame([], SCHEMA), "id", SAME, TEXTS).count() == 0
    long = "Wort " * 200_000
    df = spark.createDataFrame([(1, "x", "1", long, "b", "", 1), (2, "x", "1", long.upper(), "b", "", 1)], SCHEMA)
    assert [tuple(r) for r in copies(df, "id", SAME, TEXTS).collect()] == [(1, 2)]
