"""Points: pairs within a distance, nearest ones, gathers around a point, densest balls.

All searches go through the range join of operators.proximity, which joins distinct places and never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_km, usable
from ..session import cut_lineage, maybe_broadcast
from .proximity import place_pairs, sections


def _located(df: DataFrame, key: str, prefix: str, *also: str) -> DataFrame:
    lat, lon = F.col("lat") + 0.0, F.col("lon") + 0.0
    return df.filter(usable(F.col("lat"), F.col("lon"))).select(F.col(key).alias(f"{prefix}_id"), lat.alias(f"{prefix}_lat"), lon.alias(f"{prefix}_lon"), *[F.col(c).alias(f"{prefix}_{c}") for c in also])


def _places(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col(f"{prefix}_lat").alias("lat"), F.col(f"{prefix}_lon").alias("lon")).distinct()


def near_rows(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float, left_also: tuple[str, ...] = (), right_also: tuple[str, ...] = (), same: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(q_id, p_id, km, and q_ and p_ columns) of rows with lat and lon at most km apart.

    same: columns, among the others of both sides, that must be equal, null to null; ordered: only with q_id < p_id. Both are
    conditions of the join that turns places into rows, so what they leave out is never made.
    """
    a, b = _located(left, left_id, "q", *left_also), _located(right, right_id, "p", *right_also)
    pairs = place_pairs(_places(a, "q"), _places(b, "p"), km).hint("merge")  # their number isn't known to the optimizer
    left = pairs.join(a, ["q_lat", "q_lon"]).hint("merge")
    if not same and not ordered:
        return left.join(b, ["p_lat", "p_lon"])
    b = b.withColumnRenamed("p_lat", "_lat").withColumnRenamed("p_lon", "_lon")
    on = (F.col("p_lat") == F.col("_lat")) & (F.col("p_lon") == F.col("_lon"))
    for c in same:
        on &= F.col(f"q_{c}").eqNullSafe(F.col(f"p_{c}"))
    return left.join(b, on & (F.col("q_id") < F.col("p_id")) if ordered else on).drop("_lat", "_lon")


def grid_pairs(points: DataFrame, key: str, km: float, size: float = 0.1, strict: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, km) of different points at most km apart, smaller id first.

    strict: only those whose grid cells touch count, as in a search through neighbouring cells; this loses pairs where
    cells are narrower than the distance. Else all count. within: columns that must be equal.
    """
    pairs = near_rows(points, points, key, key, km, within, within, within, ordered=True)
    if strict:
        touch = [F.abs(cell(F.col(f"q_{c}"), size) - cell(F.col(f"p_{c}"), size)) <= 1 for c in ("lat", "lon")]
        pairs = pairs.filter(touch[0] & touch[1])
    return pairs.select(F.col("q_id").alias("id_a"), F.col("p_id").alias("id_b"), "km")


def nearest_within(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, km: float, inclusive: bool = False) -> DataFrame:
    """(q_id, p_id, km): the nearest point of each query under km, ties by the smaller id; queries without are left out."""
    pairs = near_rows(queries, points, query_id, point_id, km)
    if not inclusive:
        pairs = pairs.filter(F.col("km") < km)
    best = F.min_by(F.struct("p_id", "km"), F.struct("km", "p_id"))
    return pairs.groupBy("q_id").agg(best.alias("_b")).select("q_id", "_b.p_id", "_b.km")


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, start_km: float = 5.0) -> DataFrame:
    """(q_id, p_id, km): the nearest point of each located query, however far; ties by the smaller id.

    The distance doubles for those that found none, up to half the earth, so a query meets points at most twice as far as its
    nearest one. No points give no rows.
    """
    asked = cut_lineage(_located(queries, query_id, "q"))
    there = cut_lineage(_located(points, point_id, "p"))
    cut = sections(_places(there, "p"))
    found, km, order = None, start_km, F.struct("km", "p_id")
    while found is None or (cut.n and km < 40_200 and asked.limit(1).count()):
        pairs = place_pairs(_places(asked, "q"), cut, min(km, 20_100.0)).hint("merge")
        rows = pairs.join(asked, ["q_lat", "q_lon"]).hint("merge").join(there, ["p_lat", "p_lon"])
        some = cut_lineage(rows.groupBy("q_id").agg(F.min_by(F.struct("p_id", "km"), order).alias("_b")).select("q_id", "_b.p_id", "_b.km"))
        found = some if found is None else found.unionByName(some)
        asked = cut_lineage(asked.join(some.select("q_id"), "q_id", "left_anti"))
        km *= 2
    return found


def gathered(centres: DataFrame, points: DataFrame, centre_id: str, point_id: str, km: float, weight: str | None = None) -> DataFrame:
    """A row for each centre with points at most km away: their number, ids in order, summed weight and mean place."""
    pairs = near_rows(centres, points, centre_id, point_id, km, (), (weight,) if weight else ())
    return member_summary(pairs.select(F.col("q_id"), F.col("p_id").cast("string").alias("member"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), (F.col(f"p_{weight}") if weight else F.lit(None).cast("double")).alias("mw")), "q_id")


def member_summary(members: DataFrame, group: str) -> DataFrame:
    """members: group, member (text), lat, lon, mw. One row a group: n_members, matched_id, total_mw, lat, lon."""
    return members.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.array_join(F.array_sort(F.collect_list("member")), ",").alias("matched_id"),
        # Decimals: their sum doesn't depend on the order of the rows.
        F.round(F.sum(F.coalesce("mw", F.lit(0.0)).cast("decimal(20,6)")), 1).cast("double").alias("total_mw"),
        F.round(F.avg("lat"), 4).alias("lat"),
        F.round(F.avg("lon"), 4).alias("lon"),
    )


def densest_balls(points: DataFrame, group: str, key: str, km: float = 25.0, small: int = 3, share: float = 0.6) -> DataFrame:
    """(group, centre, gathered, core, coherent): of each group the point with most of its group's points within km.

    Ties go to the smallest key. gathered counts all rows of the group, with or without coordinates; a group without a
    located point has no centre and a core of 0. coherent: gathered is at most small, or the core holds its share.
    Neighbours are counted by the range join over places of one group only as far as they lie within km.
    """
    totals = points.groupBy(group).agg(F.count(F.lit(1)).alias("gathered"))
    pairs = near_rows(points, points, key, key, km, (group,), (group,), (group,))
    counts = pairs.groupBy(F.col(f"q_{group}").alias(group), F.col("q_id").alias("centre")).agg(F.count(F.lit(1)).alias("core"))
    best = counts.groupBy(group).agg(F.min_by(F.struct("centre", "core"), F.struct(-F.col("core"), F.col("centre"))).alias("_b"))
    joined = totals.join(best, group, "left").select(group, "_b.centre", "gathered", F.coalesce("_b.core", F.lit(0)).cast("long").alias("core"))
    coherent = (F.col("core") > 0) & ((F.col("gathered") <= small) | (F.col("core") >= share * F.col("gathered")))
    return joined.withColumn("coherent", coherent)


def ball_members(points: DataFrame, balls: DataFrame, group: str, key: str, km: float = 25.0) -> DataFrame:
    """The points of each group within km of its centre."""
    centres = balls.filter("centre IS NOT NULL").select(group, F.col("centre"))
    located = points.filter(usable(F.col("lat"), F.col("lon")))
    at = located.select(group, F.col(key).alias("centre"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    centred = maybe_broadcast(centres.join(at, [group, "centre"]))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= km
    return located.join(centred, group).filter(near).drop("centre", "_lat", "_lon")


def location_confirmed(rows: DataFrame, located: DataFrame, key: str, km: float = 30.0) -> DataFrame:
    """(key, coord_check, check_km): rows (key, lat, lon) against other coordinates (key, lat, lon) of the same key."""
    other = located.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    check = F.when(d.isNull(), "no_geocode").when(d <= km, "confirmed").otherwise("disagree")
    return rows.join(other, key, "left").select(key, check.alias("coord_check"), F.round(d, 1).alias("check_km"))
