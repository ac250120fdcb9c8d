"""Distance, grid cell and space-filling-curve expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Bits of each coordinate in a full Morton code; a cell is then under a metre wide.
CURVE_BITS = 26


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    # least() would take a null for no limit.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def haversine_np(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def cell(c: Column, size: float) -> Column:
    """Index of the grid cell, cut towards zero."""
    return (c / F.lit(float(size))).cast("int")


def usable(lat: Column, lon: Column) -> Column:
    """Whether a coordinate is a location: neither null, NaN, 0/0 nor out of range."""
    fine = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0))
    return F.coalesce(fine & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def _spread(x: np.ndarray) -> np.ndarray:
    """Moves the bits of x to the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def morton(column: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (_spread(column) | (_spread(row) << np.uint64(1))).astype("int64")


def grid_place(lat: np.ndarray, lon: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of points in the grid of 2^bits by 2^bits cells over the whole earth."""
    n = 1 << bits
    column = np.clip(np.floor((lon + 180.0) / 360.0 * n), 0, n - 1).astype("int64")
    return column, np.clip(np.floor((lat + 90.0) / 180.0 * n), 0, n - 1).astype("int64")


def curve_code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return morton(*grid_place(lat, lon, CURVE_BITS))


def disc_bits(km: float) -> int:
    """The level whose cells are about half a radius high."""
    return int(np.clip(np.floor(np.log2(180.0 / np.degrees(km / EARTH_KM) * 2)), 0, CURVE_BITS))


def disc_ranges(lat: np.ndarray, lon: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which disc, first code, last code): ranges of codes that cover the discs of a radius around points.

    Cells of one level that touch a disc's bounding box, less those whose nearest point lies outside; cells that
    follow each other on the curve make one range. Discs over the date line or a pole are covered as well.
    """
    bits = disc_bits(km)
    n = 1 << bits
    height, width = 180.0 / n, 360.0 / n
    reach = np.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    south, north = np.maximum(lat - reach, -90.0), np.minimum(lat + reach, 90.0)
    ratio = np.sin(np.radians(reach)) / np.maximum(np.cos(np.radians(lat)), 1e-12)
    polar = (np.abs(lat) + reach >= 90.0) | (ratio >= 1)
    span = np.where(polar, 180.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0))) + 1e-9)
    first_row = np.floor((south + 90.0) / height).astype("int64").clip(0, n - 1)
    last_row = np.floor((north + 90.0) / height).astype("int64").clip(0, n - 1)
    first_column = np.floor((lon - span + 180.0) / width).astype("int64")
    columns = np.minimum(np.floor((lon + span + 180.0) / width).astype("int64") - first_column + 1, n)
    rows = last_row - first_row + 1
    cells = rows * columns
    which = np.repeat(np.arange(len(lat)), cells)
    step = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    row = first_row[which] + step // columns[which]
    column = (first_column[which] + step % columns[which]) % n
    near_lat = np.clip(lat[which], row * height - 90.0, (row + 1) * height - 90.0)
    west = column * width - 180.0
    offset = (lon[which] - west + 180.0) % 360.0 - 180.0
    near_lon = west + np.clip(offset, 0, width)
    # A cell's nearest point need not be at the nearest latitude; near the poles every cell is kept.
    far = (haversine_np(lat[which], lon[which], near_lat, near_lon) > km * 1.05 + 0.001) & (np.abs(lat[which]) < 70) & (offset > -90) & (offset < 90 + width)
    which, code = which[~far], morton(column[~far], row[~far])
    order = np.lexsort((code, which))
    which, code = which[order], code[order]
    starts = np.ones(len(code), bool)
    starts[1:] = (which[1:] != which[:-1]) | (code[1:] != code[:-1] + 1)
    ends = np.append(starts[1:], True) if len(code) else starts
    shift = 2 * (CURVE_BITS - bits)
    return which[starts], code[starts] << shift, ((code[ends] + 1) << shift) - 1
