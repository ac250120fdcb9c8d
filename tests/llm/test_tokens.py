from __future__ import annotations

import random

import pytest

from plantweave.llm.mixture import mix, water_fill
from plantweave.llm.tokens import decode, encode_texts, encoding, vocabulary

TEXTS = [None, "", " ", "Hallo Welt", "<|endoftext|> bleibt Text", "a" * 5000, " " * 700 + "x", "Wörter und 1234 Zahlen's wir'll\n\n\n  x " * 80, "👩‍🔧⚡ 電力 " * 200, "\n" * 900, "x'll y're " * 300]


@pytest.mark.parametrize("chunk,overlap", [(200_000, 2_000), (100, 30), (64, 20)])
def test_ids_of_whole_texts(spark, chunk, overlap):
    rng = random.Random(chunk)
    mixed = ["".join(rng.choice(["a", " ", "\n", "  ", "é", "'s", "1", "-", "ab "]) for _ in range(600)) for _ in range(20)]
    texts = TEXTS + mixed + mixed[:2]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, body string, _text string, _i int")
    coder = encoding(vocabulary())
    out = encode_texts(df, "id", "body", chunk=chunk, overlap=overlap)
    got = {r.id: r.ids for r in out.collect()}
    assert got == {i: coder.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.id: bytes(r.b).decode() for r in out.select("id", decode(out["ids"]).alias("b")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_same_as_the_other_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    coder = encoding(vocabulary())
    assert all(t.encode(x, add_special_tokens=False).ids == coder.encode_ordinary(x) for x in TEXTS if x)


def test_no_rows(spark):
    assert encode_texts(spark.createDataFrame([], "id int, body string"), "id", "body").count() == 0


def test_water_fill():
    assert water_fill({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 100, "b": 100}, 300) == {"a": 100.0, "b": 200.0}
    assert water_fill({"a": (0.5, 9), "b": (0.25, 1), "c": (0.25, 9)}, {"a": 100, "b": 10, "c": 100}, 100) == {"a": 60.0, "b": 10.0, "c": 30.0}
    assert water_fill({"a": (0.5, 1), "b": (0.5, 4)}, {"a": 100, "b": 100}) == {"a": 100.0, "b": 100.0}
    assert water_fill({"a": (0.5, 1), "b": (0.5, 4)}, {"a": 100}) == {"a": 100.0, "b": 0.0}
    assert water_fill({}, {}) == {}


def test_mix(spark):
    docs = [(i, "wort " * (1 + i % 7), ["gross", "klein", None, "fremd"][0 if i < 300 else 1 if i < 340 else 2 if i < 350 else 3], "x") for i in range(400)] + [(1000, None, "gross", "x"), (1001, "", "klein", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens string")
    t = spark.createDataFrame([("gross", 0.4, 1, 0), ("klein", 0.4, 3, 0), ("leer", 0.2, 5, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats long, uses int")
    chosen, shares = mix(d, t)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"gross", "klein", "leer"}
    assert got["leer"].tokens == 0 and got["gross"].actual_share == pytest.approx(0.5, abs=0.01)
    rows = chosen.collect()
    assert all(1 <= r.uses <= (1 if r.source == "gross" else 3) for r in rows)
    assert sum(r.uses * r.n_tokens for r in rows) == sum(r.tokens for r in got.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(d, t)[0].collect()))
    assert mix(d.limit(0), t)[0].count() == 0 and mix(d, t.limit(0))[1].count() == 0
