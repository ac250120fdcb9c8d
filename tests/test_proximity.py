from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from plantweave.functions.geo import disc_ranges, haversine_np, morton
from plantweave.operators import proximity


def world(seed: int, n: int = 400) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    lat = np.concatenate([rng.uniform(-90, 90, n), 90 - rng.exponential(0.05, 60), rng.uniform(-1, 1, 60), np.full(40, 48.18)])
    lon = np.concatenate([rng.uniform(-180, 180, n + 60), np.where(rng.random(60) < 0.5, -180.0, 180.0) + rng.uniform(-0.1, 0.1, 60), np.full(40, 7.4)])
    return np.clip(lat, -90, 90), (lon + 180) % 360 - 180


@pytest.mark.parametrize("km", [5.0, 60.0, 700.0])
def test_against_brute_force(spark, km, monkeypatch):
    monkeypatch.setattr(proximity, "SECTION_POINTS", 60)
    monkeypatch.setattr(proximity, "SALT_RANGES", 80)
    lat, lon = world(int(km))
    df = spark.createDataFrame(pd.DataFrame({"lat": lat, "lon": lon})).distinct()
    got = {tuple(r)[:4] for r in proximity.place_pairs(df, df, km).collect()}
    places = np.unique(np.stack([lat, lon], 1), axis=0)
    d = haversine_np(places[:, None, 0], places[:, None, 1], places[None, :, 0], places[None, :, 1])
    want = {(*places[i], *places[j]) for i, j in zip(*np.nonzero(d <= km), strict=True)}
    assert got == want


def test_rows_repeat_swap_and_lack(spark):
    schema = "id long, lat double, lon double, km string, q_lat string"
    left = spark.createDataFrame([(1, 48.0, 11.0, "x", "y"), (2, 11.0, 48.0, "x", "y"), (3, None, 11.0, "x", "y"), (4, 0.0, 0.0, "x", "y"), (5, float("nan"), 1.0, None, None)], schema)
    right = spark.createDataFrame([(10, 48.0, 11.0), (11, 48.0, 11.0), (12, 48.03, 11.0), (13, 49.0, 11.0)], "other long, lat double, lon double")
    got = sorted(tuple(r)[:2] for r in proximity.rows_within(left, right, "id", "other", 5.0, swapped=True).collect())
    assert got == [(i, j) for i in (1, 2) for j in (10, 11, 12)]


def test_empty(spark):
    none = spark.createDataFrame([], "id long, lat double, lon double")
    some = spark.createDataFrame([(1, 48.0, 11.0)], "other long, lat double, lon double")
    assert proximity.rows_within(none, some, "id", "other", 5.0).count() == 0
    assert proximity.rows_within(some, none.withColumnRenamed("id", "x"), "other", "x", 5.0).count() == 0


def test_ranges_hold_the_disc():
    lat, lon = np.array([51.0]), np.array([10.0])
    _, low, high = disc_ranges(lat, lon, 5.0)
    assert (low <= high).all() and (np.diff(low) > 0).all()
    assert morton(np.array([3]), np.array([1]))[0] == 0b111
