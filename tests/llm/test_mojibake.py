from __future__ import annotations

import pytest

from plantweave.llm.mojibake import channels, spoiled_rows, spoiled_values, split_words

CLEAN = [("Windpark Süderbrücke Nord", 40), ("Wärmeauskopplung reduzieren", 900), ("Wirkleistungseinspeisung erhöhen", 900), ("Übergabewert Straße", 300), ("Solarpark Köhlmühle", 30), ("BGA Škovar", 60), ("Park Brão", 50), ("Tælvik Énorix", 70)]


def spoil(text: str, write: str, read: str) -> str:
    return text.encode(write).decode(read, "replace")


SPOILED = [
    (spoil("Wirkleistungseinspeisung erhöhen", "utf-8", "cp1252"), "Wirkleistungseinspeisung erhöhen"),
    (spoil(spoil("Wärmeauskopplung reduzieren", "utf-8", "cp1252"), "utf-8", "cp1252"), "Wärmeauskopplung reduzieren"),
    (spoil("Wärmeauskopplung reduzieren", "utf-8", "cp850"), "Wärmeauskopplung reduzieren"),
    (spoil("Solarpark Köhlmühle", "utf-8", "mac_roman"), "Solarpark Köhlmühle"),
    (spoil("Solarpark Köhlmühle", "cp1252", "cp437"), "Solarpark Köhlmühle"),
    (spoil("Solarpark Köhlmühle", "cp1252", "cp1251"), "Solarpark Köhlmühle"),
    (spoil("Solarpark Köhlmühle", "cp850", "latin-1"), "Solarpark Köhlmühle"),
    ("Solarpark K�hlm�hle", "Solarpark Köhlmühle"),
    ("Solarpark K?hlm?hle", "Solarpark Köhlmühle"),
    ("Wirkleistungseinspeisung erh鰄en", "Wirkleistungseinspeisung erhöhen"),
    (spoil("Übergabewert Straße", "utf-8", "mac_roman"), "Übergabewert Straße"),
    (spoil("BGA Škovar", "utf-8", "cp437"), "BGA Škovar"),
    ("Park Br�o", "Park Brão"),
    ("ï»¿Windpark Süderbrücke Nord", "Windpark Süderbrücke Nord"),
]
KEPT = ["Park brã\xado", "Windpark Suederbruecke Nord", "Windpark Suderbrucke Nord", "BGA Škovar", "BGA ŠKOVAR", "Park Brão", "Tælvik Énorix", "Windpark Süderbrücke Nord ?", "Windpark Süderbrücke Nord?", "Wind\xadpark\xa0Köhlmühle – „Nord“", "", " "]


def test_finds_and_restores(spark):
    rows = [*CLEAN, ("Park BrÆo", 2), *[(s, 1) for s, _ in SPOILED], *[(k, 1) for k in KEPT if k not in dict(CLEAN)], (None, 5)]
    got = {r.value: r.restored for r in spoiled_values(spark.createDataFrame(rows, "value string, n long")).collect()}
    assert got == dict(SPOILED) | {"Park BrÆo": "Park Brão"}  # ã of one code page read in another


def test_rows_of_columns(spark):
    a = spark.createDataFrame([(1, "erhÃ¶hen", "x"), (2, "erhÃ¶hen", "x"), (3, "erhöhen", "x"), (4, None, "x")], "id long, t string, value string")
    b = spark.createDataFrame([(1, "Windpark", "x")], "id long, t string, value string")
    got = sorted(tuple(r)[:3] for r in spoiled_rows([("a", a, "id", "t"), ("b", b, "id", "t")]).collect() if r.probability > 0.5)
    assert got == [("a", 1, "erhöhen"), ("a", 2, "erhöhen")]
    assert spoiled_rows([("a", a.limit(0), "id", "t"), ("b", b.limit(0), "id", "t")]).count() == 0


def test_long_text(spark):
    text = "Wort " * 50_000 + "erhÃ¶hen"
    got = spoiled_values(spark.createDataFrame([(text, 1), ("erhöhen", 9)], "value string, n long")).collect()
    assert [r.restored[-7:] for r in got] == ["erhöhen"]


@pytest.mark.parametrize("name", ["utf-8>cp1252", "utf-8>cp1252 twice", "cp1252>cp850", "cp1252>gbk", "lost"])
def test_channels(name):
    table = channels()[name]
    assert table and all(seen and letters for seen, letters in table.items())


def test_words_keep_sequences_whole():
    assert split_words("Ã\xa0la Nord\xa0Süd") == ["Ã\xa0la", "Nord", "Süd"]
