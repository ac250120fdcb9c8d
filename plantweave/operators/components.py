"""Connected components of an edge list, and their split where they spread too far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import cut_lineage
from .spatial import grid_pairs

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, component) of every id in an edge: component is the smallest id that is connected with it.

    Large-star and small-star steps in turn: the first ties all larger neighbours to the smallest one, the second the
    smaller ones, until the edges form stars; this takes about log n rounds, and minima are combined before every
    shuffle, so that an id with many edges is no burden. Each round is written to the shared folder.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        links = cut_lineage(small)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).distinct()


def with_singles(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every id with its component; ids without an edge are their own."""
    return ids.select(F.col(key).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def spread(points: DataFrame, component: str, sample_over: int = 50) -> DataFrame:
    """(component, n, span_km): an upper bound of the distance between two points of a component.

    The bound is the diagonal of the component's box, which takes one pass; only where it exceeds a limit are pairs
    looked at, by split_components.
    """
    box = points.groupBy(component).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    # Along a parallel the distance is longest where it is nearest to the equator.
    flat = F.when((F.col("min_lat") <= 0) & (F.col("max_lat") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("min_lat"), F.abs("max_lat")))
    width = haversine_km(flat, F.col("min_lon"), flat, F.col("max_lon"))
    height = haversine_km(F.col("min_lat"), F.lit(0.0), F.col("max_lat"), F.lit(0.0))
    return box.select(component, "n", F.hypot(width, height).alias("span_km"))


def diameters(points: DataFrame, component: str, key: str, sample_over: int = 50) -> DataFrame:
    """(component, km): the largest distance between points of a component, of large ones between every step-th point.

    Of a component of more than sample_over points, every (n div sample_over)-th in order of the key counts, at most
    twice sample_over, so the pairs of a component stay few however large it is.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(component).orderBy(key)
    numbered = points.select(component, key, "lat", "lon").withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(component)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / sample_over))
    kept = numbered.filter((F.col("_n") <= sample_over) | (F.col("_i") % step == 0))
    other = kept.select(component, F.col("_i").alias("_j"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return kept.join(other, component).filter("_i <= _j").groupBy(component).agg(F.max(d).alias("km"))


def clusters(points: DataFrame, key: str, radius_km: float = 10.0, widest_km: float = 30.0, least_km: float = 2.5, strict: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """(id, component): points joined by steps of at most radius_km, split where a component is wider than widest_km.

    A component that is too wide is joined anew at half the radius, as long as that is at least least_km; what is still
    too wide then stays. There are as many rounds as halvings. component is the smallest id in it.
    """
    place = points.select(F.col(key).alias("id"), "lat", "lon", *within)
    radius, rest, done = radius_km, cut_lineage(place.withColumn("_part", F.lit("").cast("string"))), None
    while True:
        found = with_singles(rest, components(grid_pairs(rest, "id", radius, strict=strict, within=(*within, "_part"))), "id")
        labelled = cut_lineage(rest.join(found, "id").drop("_part"))
        wide = labelled.join(spread(labelled, "component").filter(F.col("span_km") > widest_km).select("component"), "component", "left_semi")
        wide = diameters(wide, "component", "id").filter(F.col("km") > widest_km).select("component")
        last = radius / 2 < least_km
        settled = (labelled if last else labelled.join(wide, "component", "left_anti")).select("id", "component")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        rest = cut_lineage(labelled.join(wide, "component", "left_semi").withColumn("_part", F.col("component").cast("string")).drop("component"))
        if rest.limit(1).count() == 0:
            return done
        radius /= 2
