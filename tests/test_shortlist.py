from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF
from plantweave.functions.text import core_name, plain_name
from plantweave.operators import lookup, shortlist
from plantweave.operators.similarity import best_window, weighted
from plantweave.plans import catalogue, pipeline
from plantweave.session import table


def test_scores_and_bounds_are_those_of_single_pairs():
    rng = random.Random(1)

    def name():
        words = ["".join(rng.choice("abcdeéü-n") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        return " ".join([*words, *rng.sample([words[0], "2", "3", "nord"], rng.randint(0, 2))])

    known = sorted({t for t in (name() for _ in range(200)) if len(t) >= 4} | {"x" * 70 + " nord"})
    names = shortlist.Names(known)
    for asked in [*(name() for _ in range(60)), "nord " + "y" * 65, "漢字"]:
        want = np.array([weighted(asked, t) for t in known])
        for least in (-1.0, 60.0):
            q = shortlist.Query(asked, names)
            assert (q.bound >= want).all()
            q.rate(np.arange(len(known)), least)
            assert np.allclose(np.where(want >= least, q.score, 0), np.where(want >= least, want, 0), atol=1e-9)


def test_names_without_a_common_word_are_found(spark):
    plants = spark.createDataFrame(
        [("1", "Drisvostethagen Pumpspeicherwerk | PSW Drisvostethagen", "Hydro", 90.0), ("2", "Purmtiesfolschutz Windpark", "Wind", 0.0), ("3", "Altheim | WP Zwergsdorf", "Wind", 9.0), ("4", "Altheim", "Hard Coal", 9.0)],
        "id string, match_names string, fueltype string, capacity double",
    )
    asked = spark.createDataFrame([("psw drsvostethagen", "Erneuerbar", 100.0), ("Windpark Pürmtiesfölschütz", "Erneuerbar", 5.0), ("Zwergsdrof", None, None), ("Altheim", "Konventionell", None)], "n string, e string, mw double")
    queries = shortlist.core_queries(asked, F.col("n"), F.col("n"), F.col("e"), F.col("mw"))
    for block in (shortlist.BLOCK, 2):
        got = shortlist.most_similar(queries, plants, 20, block=block).collect()
        best = {r.entry: r.id for r in got if r["rank"] == 1}
        assert best == {"psw drsvostethagen": "1", "Windpark Pürmtiesfölschütz": "2", "Zwergsdrof": "3", "Altheim": "4"}
        assert sorted(r.id for r in got if r.entry == "Zwergsdrof") == ["1", "2", "3", "4"]
        assert [r.id for r in got if r.entry == "psw drsvostethagen"] == ["1", "2"]  # the others are too small or of another fuel


def test_fuzzy_topk_wratio_is_brute_force(spark):
    exact = table(spark, SF, "matches_exact").filter("entry_type = 'individual' AND betroffene_anlage IS NOT NULL")
    names = exact.select(plain_name(F.col("betroffene_anlage")).alias("norm"), core_name(F.col("betroffene_anlage")).alias("q"), "primaerenergieart", "max_dispatched_mw")
    names = names.groupBy("norm").agg(F.min("q").alias("q"), F.min("primaerenergieart").alias("e"), F.max("max_dispatched_mw").alias("mw"))
    plants = table(spark, SF, "candidate_index").filter("entry_type = 'individual'").select("id", "fueltype", "capacity", F.explode(F.split("match_names", r" \| ")).alias("v")).withColumn("v", core_name(F.col("v"))).filter("length(v) >= 4")
    pairs = names.crossJoin(plants).filter(lookup.fits_fuel(F.col("e"), F.col("fueltype")) & lookup.fits_power(F.col("mw"), F.col("capacity"))).select("norm", "q", "id", "v").toPandas()
    pairs["score"] = [weighted(a, b) for a, b in zip(pairs.q, pairs.v, strict=True)]
    best = pairs.groupby(["norm", "id"], as_index=False).score.max().sort_values(["norm", "score", "id"], ascending=[True, False, True])
    want = best.groupby("norm").head(20)[["norm", "id"]].reset_index(drop=True)
    got = catalogue.fuzzy_topk_wratio(spark, SF).toPandas().sort_values(["norm", "rank"])[["norm", "id"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_pipeline_lists_plants_whose_first_letters_differ(spark):
    plants = spark.createDataFrame([("1", "Drisvostethagen Pumpspeicherwerk", "Hydro", 90.0), ("2", "Altheim", "Wind", 0.0)], "id string, match_names string, fueltype string, capacity double")
    entries = spark.createDataFrame([("psw drsvostethagen", "Erneuerbar", 100.0)], "betroffene_anlage string, primaerenergieart string, max_dispatched_mw double")
    got = sorted((r["rank"], r.cand_id, r.betroffene_anlage) for r in pipeline.shortlist(entries, plants).collect())
    assert got == [(1, "1", "psw drsvostethagen"), (2, "2", "psw drsvostethagen")]


def test_prompt_holds_the_whole_shortlist(spark):
    listed = catalogue.fuzzy_topk_wratio(spark, SF).groupBy("norm").count().collect()
    lines = {r.norm: r.prompt.count("\n") for r in catalogue.prompt_text(spark, SF).collect()}
    assert lines == {r.norm: r["count"] for r in listed}
    assert max(lines.values()) > 5


def test_windows_cut_off_and_whole_ones_are_those_of_single_pairs():
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(4, 30))).strip() + "x" for _ in range(150)})
    names = shortlist.Names(known)
    for asked in ["abcdeabc", "ab cd ea bc de ab cd ea", "e", "dddd"]:
        for rows in (np.flatnonzero(names.size > len(asked)), np.flatnonzero(names.size < len(asked))):
            if len(rows):
                got = np.maximum(names.ends(0, asked, rows), shortlist._windows(names.masks(asked), len(asked), names.plain[:, rows], names.size[rows]))
                assert np.allclose(got, [best_window(asked, known[i]) for i in rows], atol=1e-9)


def test_names_whose_score_their_words_tell_are_not_searched(monkeypatch):
    known = [f"{c * 15}{i} 7" for c in "abcdefgh" for i in range(50)]
    query = shortlist.Query("xyz 7", shortlist.Names(known))
    searched = []
    monkeypatch.setattr(shortlist.Names, "common", lambda self, at, text, rows: searched.extend(rows) or np.zeros(len(rows), "int64"))
    got = shortlist._best(query, np.arange(len(known)), np.arange(len(known)), np.arange(len(known)), np.array([f"{i:03}" for i in range(len(known))]), 20)
    assert got == [(f"{i:03}", weighted("xyz 7", known[i])) for i in range(20)]
    assert not searched


def test_bounds_hold_for_names_of_hundreds_of_letters():
    known = ["x" * 300, "x" * 290 + " nord", "nord xx"]
    query = shortlist.Query("x" * 280, shortlist.Names(known))
    assert (query.bound >= [weighted(query.text, t) for t in known]).all()


def test_best_plants_are_brute_force_and_told_names_are_not_rated(monkeypatch):
    rng = random.Random(6)
    texts = sorted({" ".join(rng.choice(["abc", "nord", "7", "wp", "cabd", "x" * 66, "dabe", "be", "solarpark", "a" * 17]) for _ in range(rng.randint(1, 5))) for _ in range(260)}, key=len)
    of = np.array([rng.randrange(len(texts)) for _ in range(500)])
    number = np.sort(np.array([rng.randrange(200) for _ in of]))
    number = np.unique(number, return_inverse=True)[1]
    ids, fits = np.array([f"{n:03}" for n in number]), np.array([rng.random() < 0.7 for _ in of])
    names, rated, rate = shortlist.Names(texts), [], shortlist.Query.rate
    monkeypatch.setattr(shortlist.Query, "rate", lambda self, rows, least: rated.append(len(rows)) or rate(self, rows, least))
    for asked in ["wp dabecabd", "nord", "abc abc", "7 solarpark nord", "e", "x" * 70, "zz 7"]:
        score = {i: max(weighted(asked, texts[o]) for o, j, f in zip(of, ids, fits, strict=True) if f and i == j) for i in {*ids[fits]}}
        want = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:20]
        got = shortlist._best(shortlist.Query(asked, names), np.flatnonzero(fits), of, number, ids, 20)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)
    rated.clear()
    known = [f"{c * 15}{i} 7" for c in "abcdefgh" for i in range(50)]
    every = np.arange(len(known))
    shortlist._best(shortlist.Query("xyz 7", shortlist.Names(known)), every, every, every, np.array([f"{i:03}" for i in every]), 20)
    assert sum(rated) == 0


def test_ends_that_reach_least_are_those_of_all():
    rng = random.Random(7)
    known = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(4, 40))).strip() + "x" for _ in range(200)})
    names = shortlist.Names(known)
    for asked in ["abcdabcadbca", "ab cd ad bc ab"]:
        for rows in (np.flatnonzero(names.size > len(asked)), np.flatnonzero(names.size < len(asked))):
            every, some = names.ends(0, asked, rows), names.ends(0, asked, rows, 60.0)
            assert (every >= 60).any() and (every < 60).any()
            assert (some[every >= 60] == every[every >= 60]).all() and (some <= every).all()


def _long_names(rng: random.Random, n: int) -> list[str]:
    place = lambda: "".join(rng.choice(["dris", "vost", "et", "hagen", "liend", "vük", "niel", "ach"]) for _ in range(rng.randint(2, 4)))
    return sorted({" ".join(rng.sample([rng.choice(["biogasanlage", "pumpspeicherwerk", "bga"]), place(), str(rng.randint(1, 9))], rng.randint(1, 3))) for _ in range(n)}, key=len)


def test_letters_of_windows_bound_the_best_window():
    rng = random.Random(8)
    known = [t for t in _long_names(rng, 400) if len(t) >= 4]
    names = shortlist.Names(known)
    in_order = [" ".join(sorted(t.split())) for t in known]
    for asked in ["drisvostliendniel", "hagen 3", "pumpspeicherwerk vükachliendnielhagen 7 z"]:
        ordered = " ".join(sorted(asked.split()))
        longer, shorter = np.flatnonzero(names.size > len(asked)), np.flatnonzero(names.size < len(asked))
        for form, text, texts in ((0, asked, known), (1, ordered, in_order)):
            for rows, bound in ((longer, lambda r, f=form, t=text: names.longer_windows(f, t, r)), (shorter, lambda r, t=text: names.shorter_windows(t, r))):
                rows = rows[names.size[rows] <= shortlist.CUT * shortlist.CUTS]
                if len(rows):
                    want = np.array([best_window(text, texts[i]) for i in rows])
                    assert (bound(rows) + 1e-3 >= want).all()


def test_names_whose_windows_cannot_be_among_the_best_are_not_searched(monkeypatch):
    rng = random.Random(9)
    known = _long_names(rng, 3000)
    every = np.arange(len(known))
    searched, common = set(), shortlist.Names.common
    monkeypatch.setattr(shortlist, "FEW", 0, raising=False)
    monkeypatch.setattr(shortlist.Names, "common", lambda self, form, text, rows: searched.update(rows.tolist()) or common(self, form, text, rows))
    for asked, most in (("drsvostlindniel", 800), ("zubzamgönd", 1_150)):
        searched.clear()
        got = shortlist._best(shortlist.Query(asked, shortlist.Names(known)), every, every, every, np.array([f"{i:04}" for i in every]), 20)
        want = sorted(((f"{i:04}", weighted(asked, t)) for i, t in enumerate(known)), key=lambda p: (-p[1], p[0]))[:20]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)
        assert len(searched) < most


def test_one_name_asked_for_other_sizes_gets_its_own_best():
    rng = random.Random(10)
    known = _long_names(rng, 600)
    every, ids = np.arange(len(known)), np.array([f"{i:03}" for i in range(len(known))])
    for asked in ["drisvosthagen", "bga drisvosthagen"]:
        query = shortlist.Query(asked, shortlist.Names(known))
        for rows in (every, every[::7], every[3::29]):  # fewer plants fit from one to the next, so that lower scores count
            got = shortlist._best(query, rows, every, every, ids, 20)
            want = sorted(((ids[i], weighted(asked, known[i])) for i in rows), key=lambda p: (-p[1], p[0]))[:20]
            assert [i for i, _ in got] == [i for i, _ in want]
            assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)
