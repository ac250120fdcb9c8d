from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from plantweave.functions import figures, text
from plantweave.functions.days import local_day, written_moment
from plantweave.functions.geo import haversine_np
from plantweave.operators import components, decisions, entries, lookup, registry, similarity, spatial


def values(spark, items, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], schema).select(column).collect()]


def test_plain_name(spark):
    items = ["WP_JUECHEN", "50H Berlin Mitte", "Emsland (EON)", "\xa0Über-See\xa0 5!", None, ""]
    assert values(spark, items, text.plain_name(F.col("x"))) == ["wp juechen", "berlin mitte", "emsland", "über-see 5", None, ""]
    assert values(spark, ["WP_JUECHEN", "50h Berlin"], text.plain_name(F.col("x"), False, False)) == ["wp_juechen", "50h berlin"]


def test_core_name_falls_back(spark):
    assert values(spark, ["Kraftwerk Block T411", "Windpark Nord GmbH"], text.core_name(F.col("x"))) == ["kraftwerk block t411", "nord"]


def test_parts_and_rules(spark):
    names = ["Boxberg, Goldisthal, Jänschwalde", "Heizkraftwerk Stuttgart-Münster GT 16,17,18", "börse X", "SHN Cluster Y", "A_CR_WIND", "UW Büttel", "EE Bayern", "Notfall 1", "KW Vianden"]
    want = ["multi_plant", "individual", "countertrade", "cluster", "control_reserve", "substation", "regional_renewable", "emergency", "foreign"]
    assert values(spark, names, text.entry_type(F.col("x"))) == want
    assert values(spark, ["X_CR_WIND", "WINDPARK Y", "UW Büttel", "UW Altheim", "OWP UW Z"], text.told_technology(F.col("x"))) == ["Wind", "", "Wind", "", "Wind"]


def test_numbers_and_ids(spark):
    assert values(spark, ["1,5", "abc", None, "-2,25", "NaN"], text.decimal_comma(F.col("x"))) == [1.5, None, None, -2.25, None]
    df = spark.createDataFrame([("{'MASTR': ['MASTR-SEE1'], 'OPSD': ['B1', 'B2']}", "11W"), ("broken", "{nan}"), (None, None)], "p string, e string")
    assert [tuple(r) for r in df.select(*text.id_lists(F.col("p"), F.col("e"))).collect()] == [(["SEE1"], ["B1", "B2"], ["11W"]), ([], [], []), ([], [], [])]
    assert values(spark, ["Höfe/Nord 1"], text.percent_encoded(F.col("x"))) == ["H%C3%B6fe/Nord%201"]
    assert values(spark, [" High ", "", None], text.known_confidence(F.col("x"))) == ["high", "none", "none"]


def test_days(spark):
    df = spark.createDataFrame([("28.03.2021", "02:30", "CET"), ("31.10.2021", "02:30", "x"), ("31.12.2020", "23:30", "UTC"), ("30.02.2021", "01:00", "CET"), (None, "01:00", "CET")], "d string, t string, z string")
    got = [str(r[0]) if r[0] else None for r in df.select(local_day(written_moment(F.col("d"), F.col("t")), F.col("z"))).collect()]
    assert got == [None, None, "2021-01-01", None, None]


def test_figures(spark):
    assert values(spark, [0.0, 1.4, 23.0, 69.0, 71.0], figures.round_number(F.col("x")), "x double") == [0.0, 1.0, 20.0, 50.0, 100.0]
    df = spark.createDataFrame([(55.0, 45.0), (54.0, 46.0), (0.0, 0.0), (1.0, 9.0)], "i double, d double")
    assert [r[0] for r in df.select(figures.balance(F.col("i"), F.col("d"))).collect()] == ["increase", "balanced", "balanced", "decrease"]


def test_entries(spark):
    rows = [("A", "b", "1,5", "X"), (" A ", "a", "2", None), ("A", "a", "x", "Y"), ("A", "b", None, "X"), ("", "a", "1", "X"), (None, "a", "1", "X"), ("nan", "a", "1", "X"), ("B", None, None, None)]
    df = spark.createDataFrame(rows, "betroffene_anlage string, primaerenergieart string, maximale_leistung_mw string, anweisender_uenb string")
    got = {r.betroffene_anlage: r for r in entries.entries(df).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].primaerenergieart, got["A"].energy_conflict, got["A"].max_dispatched_mw, got["A"].tsos, got["A"].n_events) == ("a", True, 2.0, "X,Y", 4)
    assert (got["B"].primaerenergieart, got["B"].tsos) == ("", "")


def test_union_and_precedence(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert entries.united(a, b).count() == 3
    assert sorted(tuple(r) for r in entries.last_wins([a, b.withColumn("v", F.upper("v"))], "k").collect()) == [(1, "X"), (2, "Y")]


def test_unique_hits_and_guard(spark):
    index = spark.createDataFrame([("a", "1", "index"), ("b", "1", "index"), ("b", "2", "index")], "norm string, candidate string, id_source string")
    q = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "betroffene_anlage string")
    assert sorted((r.betroffene_anlage, r.candidate, r.n_candidates) for r in lookup.unique_hits(q, index).collect()) == [("A", "1", 1), ("B", None, 2)]
    picks = spark.createDataFrame([("A", "1"), ("B", "9"), ("C", None)], "e string, c string")
    short = spark.createDataFrame([("A", "1"), ("B", "2")], "e string, c string")
    assert sorted(tuple(r) for r in lookup.guarded(picks, short, "e", "c").collect()) == [("A", "1", False), ("B", None, True), ("C", None, False)]


def test_fits_power(spark):
    df = spark.createDataFrame([(0.0,), (6.9,), (7.0,), (None,)], "c double")
    assert [r[0] for r in df.select(lookup.fits_power(F.lit(10.0), F.col("c"))).collect()] == [True, False, True, True]


def test_similarity():
    assert similarity.ratio("abc", "abc") == 100 and similarity.ratio("abcd", "abed") == pytest.approx(75)
    assert similarity.common("abcbdab", "bdcaba") == 4
    assert similarity.weighted("irsching 4", "4 irsching") == pytest.approx(95)
    assert similarity.weighted("", "x") == 0
    assert similarity.weighted("altheim", "altheim solar freiflaeche nord") >= 85


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "id_a int, id_b int")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "id_a int, id_b int")).count() == 0


def test_chain_is_split(spark):
    chain = [(i, 50.0 + i * 0.08, 10.0) for i in range(8)] + [(100 + i, 52.0, 12.0 + i * 0.01) for i in range(4)]
    df = spark.createDataFrame(chain, "id int, lat double, lon double")
    got = {r.id: r.component for r in components.clusters(df, "id").collect()}
    assert len({got[i] for i in range(8)}) == 8  # 8.9 km apart: apart at 5 km
    assert {got[100 + i] for i in range(4)} == {100}


def test_grid_rule(spark):
    df = spark.createDataFrame([("a", 51.0, 10.099), ("b", 51.0, 10.201)], "id string, lat double, lon double")
    assert spatial.grid_pairs(df, "id", 10.0).count() == 0
    assert spatial.grid_pairs(df, "id", 10.0, strict=False).count() == 1


def test_nearest_strict_and_far(spark):
    half = math.degrees(0.5 / 6371.0)
    q = spark.createDataFrame([("q", 50.0, 10.0)], "id string, lat double, lon double")
    p = spark.createDataFrame([("far", 50.0 + half * 1.0000001, 10.0), ("antipode", -50.0, -170.0)], "pid string, lat double, lon double")
    assert spatial.nearest_within(q, p, "id", "pid", 0.5).count() == 0
    assert spatial.nearest(q, p.filter("pid = 'antipode'"), "id", "pid").first().p_id == "antipode"


def test_densest_ball(spark):
    rows = [("g", f"p{i}", 50.0 + i * 0.01, 10.0) for i in range(4)] + [("g", f"x{i}", 54.0 + i, 8.0) for i in range(3)] + [("h", "y", None, None), ("k", "z", 50.0, 10.0)]
    df = spark.createDataFrame(rows, "g string, id string, lat double, lon double").withColumn("key", F.struct("g", "id"))
    got = {r.g: (r.centre["id"] if r.centre else None, r.gathered, r.core, r.coherent) for r in spatial.densest_balls(df, "g", "key").collect()}
    assert got == {"g": ("p0", 7, 4, False), "h": (None, 1, 0, False), "k": ("z", 1, 1, True)}


def test_farms(spark):
    rows = [("A", "Wind", 1, 2.0, 50.0, 10.0), ("A", "Wind", 2, 3.0, 50.001, 10.0), ("B", "Wind", 3, 1.0, 50.0, 10.0), ("B", "Wind", 4, 1.0, 54.0, 10.0), ("C", None, 5, 1.0, 50.0, 10.0), ("D", "Wind", 6, 1.0, None, None), ("D", "Wind", 7, 1.0, None, None)]
    df = spark.createDataFrame(rows, "name string, fuel string, id int, capacity double, lat double, lon double")
    got = {(r.name, r.id): (r.capacity, r.n_units) for r in registry.farms(df, ["name", "fuel"], "id").collect()}
    assert got == {("A", 1): (5.0, 2), ("B", 3): (1.0, 1), ("B", 4): (1.0, 1), ("D", 6): (2.0, 2)}
    assert registry.farms(df, ["name", "fuel"], "id", keep_null_keys=True).filter("name = 'C'").count() == 1


def test_gaps(spark):
    half = math.degrees(0.4 / 6371.0)
    spine = spark.createDataFrame([("s1", 50.0, 10.0, ["B1"])], "id string, lat double, lon double, opsd array<string>")
    other = spark.createDataFrame([("B1", 50.0, 10.0), ("B2", 50.0 + half, 10.0), ("B3", 51.0, 10.0), ("B4", None, None)], "id string, lat double, lon double")
    near, new = registry.filled_gaps(spine, other, F.col("opsd"))
    assert [(r.other_id, r.id) for r in near.collect()] == [("B2", "s1")]
    assert sorted(r.id for r in new.collect()) == ["B3", "B4"]


def test_composed_keeps_order(spark):
    bundles = spark.createDataFrame([("Boxberg, Goldisthal",), ("Goldisthal, Nirgendwo",), ("Xxxx, Yyyy",), ("Boxberg",)], "betroffene_anlage string")
    matches = spark.createDataFrame([("Boxberg", "9", "Bx", 2.0, 50.0, 10.0), ("Goldisthal", "1", "Go", 3.0, 52.0, 12.0)], "betroffene_anlage string, matched_id string, matched_name string, capacity double, lat double, lon double")
    got = {r.betroffene_anlage: (r.matched_id, r.matched_name, r.capacity_mw, r.lat, r.confidence) for r in decisions.composed(bundles, matches).collect()}
    assert got == {"Boxberg, Goldisthal": ("9,1", "Bx + Go", 5.0, 51.0, "high"), "Goldisthal, Nirgendwo": ("1", "Go", 3.0, 52.0, "medium")}


def test_haversine_matches_column(spark):
    from plantweave.functions.geo import haversine_km

    got = spark.range(1).select(haversine_km(F.lit(50.0), F.lit(8.0), F.lit(51.0), F.lit(9.0))).first()[0]
    assert got == pytest.approx(float(haversine_np(50.0, 8.0, 51.0, 9.0)))


def test_first_listed_and_bridge(spark):
    rows = spark.createDataFrame([("r1", ["x", "b", "a"]), ("r2", ["x"]), ("r3", [])], "id_ string, ids array<string>")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert [tuple(r) for r in registry.first_listed(rows, "id_", "ids", names).collect()] == [("r1", "B")]
    bn = spark.createDataFrame([("n", "SEE1", "bnetza"), ("n", "SEE2", "bnetza")], "norm string, candidate string, id_source string")
    crossing = spark.createDataFrame([("SEE1", "9"), ("SEE1", "7")], "candidate string, other string")
    assert sorted(tuple(r) for r in lookup.bridged(bn, crossing).collect()) == [("n", "7", "index"), ("n", "SEE2", "bnetza")]


def test_filled_places(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", 1.0, 2.0, None), ("c", None, None, "index")], "k string, lat double, lon double, coord_source string")
    other = spark.createDataFrame([("a", 5.0, 6.0), ("b", 7.0, 8.0)], "k string, lat double, lon double")
    got = {r.k: (r.lat, r.lon, r.coord_source) for r in decisions.filled_places(rows, other, "k").collect()}
    assert got == {"a": (5.0, 6.0, "geocode"), "b": (1.0, 2.0, "index"), "c": (None, None, "none")}


def test_location_check(spark):
    rows = spark.createDataFrame([("a", 50.0, 10.0), ("b", 50.0, 10.0), ("c", 50.0, 10.0)], "k string, lat double, lon double")
    other = spark.createDataFrame([("a", 50.1, 10.0), ("b", 52.0, 10.0)], "k string, lat double, lon double")
    assert {r.k: r.coord_check for r in spatial.location_confirmed(rows, other, "k").collect()} == {"a": "confirmed", "b": "disagree", "c": "no_geocode"}
