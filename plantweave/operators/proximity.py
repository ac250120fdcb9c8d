"""Points near other points: a range join on the sorted codes of a space-filling curve.

Points get the Morton code of their place. A disc around a query point is covered by ranges of codes. Quantiles
of the codes cut the curve into sections that hold about as many points each, however dense a place is; a range
goes to every section that it meets, and sections with many ranges are split by a salt that repeats their
(bounded) points. Each section is then read once in the order of its codes: points first, ranges against them by
binary search, candidates refined by the exact distance. Places that occur more than once are joined once and
put back to their rows afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import curve_code, disc_ranges, haversine_np, usable
from ..session import cut_lineage

#: Points of a section, ranges of a section's salt, and candidates held at once.
SECTION_POINTS, SALT_RANGES, BLOCK = 100_000, 100_000, 500_000
MOST_SECTIONS = 4096

_SECTIONED = "section int, salt int, kind int, code long, last long, lat double, lon double"
_PAIR = "q_lat double, q_lon double, p_lat double, p_lon double, km double"


def upright(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates in their right order, where every true latitude exceeds the longitude."""
    return F.greatest(lat, lon), F.least(lat, lon)


def _sweep(km: float):
    def flush(q: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        first = np.searchsorted(p["code"], q["code"], side="left")
        count = np.searchsorted(p["code"], q["last"], side="right") - first
        total = np.cumsum(count)
        at = 0
        while at < len(count):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + BLOCK, side="right")))
            for part in range(0, int(count[at]) if to == at + 1 else 1, BLOCK):
                c = np.minimum(count[at:to] - part, BLOCK) if to == at + 1 else count[at:to]
                which = np.repeat(np.arange(at, to), c)
                place = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + first[which] + part
                d = haversine_np(q["lat"][which], q["lon"][which], p["lat"][place], p["lon"][place])
                ok = d <= km
                if ok.any():
                    which, place = which[ok], place[ok]
                    yield pd.DataFrame({"q_lat": q["lat"][which], "q_lon": q["lon"][which], "p_lat": p["lat"][place], "p_lon": p["lon"][place], "km": d[ok]})
            at = to

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, points, frozen = None, [], None
        for pdf in batches:
            keys = pdf.section.to_numpy("int64") << 32 | pdf.salt.to_numpy("int64")
            for a, b in _runs(keys):
                if keys[a] != group:
                    group, points, frozen = keys[a], [], None
                part = pdf.iloc[a:b]
                own = part[part.kind == 0]
                if len(own):
                    points.append({c: own[c].to_numpy() for c in ("code", "lat", "lon")})
                ranges = part[part.kind == 1]
                if len(ranges) and points:
                    if frozen is None:
                        frozen = {c: np.concatenate([x[c] for x in points]) for c in ("code", "lat", "lon")}
                    yield from flush({c: ranges[c].to_numpy() for c in ("code", "last", "lat", "lon")}, frozen)

    return run


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    yield from zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else ()


@dataclass
class Sections:
    """Distinct points (lat, lon, code), their number, and the codes at which the curve is cut."""

    coded: DataFrame
    n: int
    cuts: np.ndarray


def sections(points: DataFrame) -> Sections:
    """points: distinct rows (lat, lon) of usable coordinates."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(code=curve_code(pdf.lat.to_numpy(), pdf.lon.to_numpy()))

    coded = cut_lineage(points.mapInPandas(encode, "lat double, lon double, code long"))
    n = coded.count()
    wanted = min(MOST_SECTIONS, -(-n // SECTION_POINTS))
    if wanted <= 1:
        return Sections(coded, n, np.array([], "int64"))
    at = coded.agg(F.percentile_approx("code", [i / wanted for i in range(1, wanted)], 20_000)).first()[0]
    return Sections(coded, n, np.unique(np.array(at, "int64")))


def place_pairs(queries: DataFrame, points: DataFrame | Sections, km: float) -> DataFrame:
    """Pairs of places (q_lat, q_lon, p_lat, p_lon, km) at most km apart.

    queries and points: distinct rows (lat, lon) of usable coordinates; points may be given as their sections, to be
    searched more than once. Empty inputs give no pair.
    """
    cut = points if isinstance(points, Sections) else sections(points)
    coded, cuts = cut.coded, cut.cuts
    if not cut.n:
        return coded.sparkSession.createDataFrame([], _PAIR)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 10_000):
                pdf = whole.iloc[at : at + 10_000]
                lat, lon = pdf.lat.to_numpy(), pdf.lon.to_numpy()
                which, low, high = disc_ranges(lat, lon, km)
                a, b = np.searchsorted(cuts, low, side="right"), np.searchsorted(cuts, high, side="right")
                row = np.repeat(np.arange(len(which)), b - a + 1)
                section = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1)
                yield pd.DataFrame({"section": section.astype("int32"), "code": low[row], "last": high[row], "lat": lat[which[row]], "lon": lon[which[row]]})

    ranges = cut_lineage(queries.mapInPandas(cover, "section int, code long, last long, lat double, lon double"))
    # One row a section, and there are at most MOST_SECTIONS.
    salts = np.ones(len(cuts) + 1, "int64")
    for section, count in ranges.groupBy("section").count().collect():
        salts[section] = -(-count // SALT_RANGES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            section = np.searchsorted(cuts, pdf.code.to_numpy(), side="right")
            times = salts[section]
            row = np.repeat(np.arange(len(pdf)), times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = pdf.iloc[row]
            yield pd.DataFrame({"section": section[row].astype("int32"), "salt": salt.astype("int32"), "kind": np.zeros(len(row), "int32"), "code": out.code, "last": out.code, "lat": out.lat, "lon": out.lon})

    def salted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            section = pdf.section.to_numpy("int64")
            salt = pd.util.hash_array(pdf.lat.to_numpy() * 1e3 + pdf.lon.to_numpy()) % salts[section].astype("uint64")
            yield pdf.assign(salt=salt.astype("int32"), kind=np.int32(1))[["section", "salt", "kind", "code", "last", "lat", "lon"]]

    both = coded.mapInPandas(place, _SECTIONED).unionByName(ranges.mapInPandas(salted, _SECTIONED))
    return both.repartition("section", "salt").sortWithinPartitions("section", "salt", "kind", "code").mapInPandas(_sweep(km), _PAIR)


def rows_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, swapped: bool = False) -> DataFrame:
    """Rows of left and right (each with its id, lat, lon) at most km apart: (left_id, right_id, km).

    swapped: coordinates may have been entered in the wrong order; the larger is the latitude. Null, NaN and 0/0
    coordinates are no location and give no pair. Repeated rows all count; empty tables give no pair. Other
    columns are ignored, so clashing names do no harm.
    """

    def located(df: DataFrame, key: str, prefix: str) -> DataFrame:
        lat, lon = upright(F.col("lat"), F.col("lon")) if swapped else (F.col("lat"), F.col("lon"))
        # Adding 0.0 makes -0.0 and 0.0 one value.
        return df.filter(usable(F.col("lat"), F.col("lon"))).select(F.col(key), (lat + 0.0).alias(f"{prefix}_lat"), (lon + 0.0).alias(f"{prefix}_lon")).filter(usable(F.col(f"{prefix}_lat"), F.col(f"{prefix}_lon")))

    a, b = located(left, left_id, "q"), located(right, right_id, "p")
    places = lambda df, x: df.select(F.col(f"{x}_lat").alias("lat"), F.col(f"{x}_lon").alias("lon")).distinct()
    pairs = place_pairs(places(a, "q"), places(b, "p"), km)
    # The optimizer can't know the number of pairs, so they are never broadcast.
    return pairs.hint("merge").join(a, ["q_lat", "q_lon"]).hint("merge").join(b, ["p_lat", "p_lon"]).select(left_id, right_id, "km")
