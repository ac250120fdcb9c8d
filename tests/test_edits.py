from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from plantweave.operators import edits
from plantweave.plans import catalogue


def _names(rng, n, most=4):
    return ["".join(rng.choice("abcdeéß?- ") for _ in range(rng.randint(4, 9))) + " nord" * rng.randint(0, most) for _ in range(n)]


def test_edits_are_those_of_single_pairs(spark):
    rng = random.Random(3)
    texts = [t.encode("ascii", "replace").decode() for t in [*_names(rng, 60), *_names(rng, 20, 30), "x" * 300]]
    asked = [t.encode("ascii", "replace").decode() for t in [*_names(rng, 12), "nord " * 30, "x" * 200, ""]]
    pairs = spark.createDataFrame([(a, b) for a in asked for b in texts], "a string, b string")
    want = {(r.a, r.b): r.d for r in pairs.select("a", "b", F.levenshtein("a", "b").alias("d")).collect()}
    for bits in (32, 64, 0):
        some = [t for t in texts if not bits or len(t) <= bits]
        known = edits.Variants(some, bits)
        for a in asked:
            d = np.array([want[a, b] for b in some])
            assert (known.fewest_edits(a.encode(), len(some)) <= d).all()
            assert (known.distances(a.encode(), np.arange(len(some))) == d).all()


def test_best_variants_are_brute_force_in_partitions_too(spark):
    rng = random.Random(4)
    fuels = ["Wind", "Solar", "Lignite", None, "Other heat"]
    plants = [(str(i % 60), v, fuels[i % 5], [None, 0.0, 3.0, 8.0, float("nan")][i % 7 % 5]) for i, v in enumerate(_names(rng, 300))]
    asked = [(q, ["Erneuerbar", "Konventionell", "Sonstiges", None][i % 4], [None, 5.0, 12.0][i % 3]) for i, q in enumerate(sorted({*_names(rng, 16), "nord " * 20}))]
    fits = {"Erneuerbar": ["Wind", "Solar"], "Konventionell": ["Lignite"]}
    pairs = [(q, i, v) for q, e, mw in asked for i, v, f, c in plants if (e not in fits or f in fits[e]) and (mw is None or not c or c != c or c >= mw * 0.7)]
    plain = spark.createDataFrame(pairs, "q string, i string, v string").withColumn("s", F.levenshtein(edits.ascii_letters(F.col("q")), edits.ascii_letters(F.col("v"))) / F.greatest(F.length("q"), F.length("v"))).collect()
    want = {}
    for q, *_ in asked:
        first = dict.fromkeys(r.i for r in sorted((r for r in plain if r.q == q), key=lambda r: (r.s, r.v, r.i))[:30])
        want[q] = [*first][:6]
    queries, variants = spark.createDataFrame(asked, "query string, energy string, mw double"), spark.createDataFrame(plants, "id string, variant string, fueltype string, capacity double")
    for partition in (edits.PARTITION, 70):
        got = edits.fewest_edits(queries, variants, 6, most=30, partition=partition).orderBy("query", "rank").collect()
        assert {q: [r.id for r in got if r["query"] == q] for q in want} == want


def test_guard_and_list_rest_on_the_search_by_edits(spark, monkeypatch):
    listed = spark.createDataFrame([("abc", "7", 1.0, 1), ("abc", "5", 0.5, 2), ("abcd", "8", 1.0, 1)], "query string, id string, score double, rank int")
    monkeypatch.setattr(catalogue.edits, "fewest_edits", lambda queries, variants, k: listed)
    got = sorted((r.norm, r.id, r.rejected) for r in catalogue.hallucination_guard(spark, SF).collect())
    assert got == [("abc", None, True), ("abcd", "8", False)]
    assert catalogue.fuzzy_topk_lev(spark, SF).count() == 3
