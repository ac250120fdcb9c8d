"""Registries integrated into one index: units merged to farms, gaps filled from another registry, clusters summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import plain_name, union_sorted
from ..session import cut_lineage
from .spatial import nearest_within

# Fuels of the second registry in the words of the first.
FUEL_NAMES = {
    "Natural gas": "Natural Gas", "Hydro": "Hydro", "Hard coal": "Hard Coal", "Waste": "Waste", "Lignite": "Lignite", "Oil": "Oil",
    "Nuclear": "Nuclear", "Biomass and biogas": "Solid Biomass", "Other fuels": "Other", "Other fossil fuels": "Other", "Mixed fossil fuels": "Other",
}
CLUSTER_FUELS = ["Wind", "Solar", "Biogas"]


def first_listed(rows: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """(key, name): for each row the name of the first id of its list that has one; names: (id, name)."""
    listed = rows.select(key, F.posexplode(ids).alias("_i", "id"))
    return listed.join(names, "id").groupBy(key).agg(F.min_by("name", F.struct("_i", "name")).alias("name"))


def farms(units: DataFrame, keys: list[str], order: str, km: float = 50.0, keep_null_keys: bool = False, lists: tuple[str, ...] = (), firsts: tuple[str, ...] = ()) -> DataFrame:
    """Units of equal keys merged to one row if all lie within km of their mean place; else kept as they are.

    units: the keys, order, id, capacity, lat, lon. Result: keys, id (of the first unit), capacity, lat, lon, n_units,
    source_ids. Rows with a null key are left out unless keep_null_keys. Units without coordinates never part a farm.
    lists: columns of arrays that are united, distinct and sorted, without empty texts. firsts: columns of which the first unit's value
    that is neither null nor empty counts. A group is summed up before it meets its rows, so a hot key needs no window over all its rows.
    """
    if not keep_null_keys:
        units = units.dropna(subset=keys)
    means = units.groupBy(*keys).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
    same = [units[k].eqNullSafe(means[k]) for k in keys]
    on = same[0]
    for x in same[1:]:
        on &= x
    measured = units.join(means, on).select(units["*"], haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("_d"))
    summed = measured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("_span"), F.min_by("id", F.struct(order, "id")).alias("id"),
        F.sum("capacity").alias("capacity"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("source_ids"),
        *[union_sorted(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in lists],
        *[F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct(order, "id"))).alias(c) for c in firsts],
    )
    merged = summed.filter((F.col("n_units") > 1) & (F.col("_span") <= km)).drop("_span")
    kept = summed.filter((F.col("n_units") == 1) | (F.col("_span") > km)).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = None
    for k in keys:
        x = units[k].eqNullSafe(kept[f"_k_{k}"])
        on = x if on is None else on & x
    alone = units.join(kept, on, "left_semi").select(*keys, "id", "capacity", "lat", "lon", F.lit(1).cast("long").alias("n_units"), F.col("id").cast("string").alias("source_ids"),
        *[F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""))).alias(c) for c in lists], *[F.nullif(F.col(c), F.lit("")).alias(c) for c in firsts])
    return merged.select(alone.columns).unionByName(alone)


def filled_gaps(spine: DataFrame, other: DataFrame, referenced: Column, km: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(reconciled, new) of other's rows whose id no list of the spine holds.

    spine: id, lat, lon and the lists. other: id, lat, lon. reconciled: (other_id, id, km) of those strictly closer
    than km to a plant of the spine; new: the rows of other that are not.
    """
    known = spine.select(F.explode(referenced).alias("id")).distinct()
    missing = other.withColumn("id", F.col("id").cast("string")).join(known, "id", "left_anti")
    near = nearest_within(missing, spine, "id", "id", km).select(F.col("q_id").alias("other_id"), F.col("p_id").alias("id"), "km")
    new = missing.join(near.select(F.col("other_id").alias("id")), "id", "left_anti")
    return near, new


def with_gaps_filled(spine: DataFrame, other: DataFrame, referenced: str, km: float = 0.5) -> DataFrame:
    """The spine with what another registry adds: ids of reconciled rows in the list `referenced`, and new rows.

    spine: id (text), name, fueltype, capacity, lat, lon, and the list. other: the same without the list. A row that is
    reconciled also fills in the plant's missing fuel and capacity (ties by the smaller id); a new one has its own id in the list.
    """
    near, new = filled_gaps(spine, other, F.col(referenced), km)
    told = near.join(other.select(F.col("id").cast("string").alias("other_id"), F.col("fueltype").alias("_f"), F.col("capacity").alias("_c")), "other_id")
    added = told.groupBy("id").agg(F.collect_list("other_id").alias("_ids"), F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("other_id"))).alias("_f"), F.min_by("_c", F.when(F.col("_c") > 0, F.col("other_id"))).alias("_c"))
    columns = ["id", "name", "fueltype", "capacity", "lat", "lon", referenced]
    united = F.array_sort(F.array_distinct(F.concat(referenced, F.coalesce("_ids", F.array().cast("array<string>")))))
    size = F.when(F.coalesce("capacity", F.lit(0.0)) == 0, F.coalesce("_c", "capacity")).otherwise(F.col("capacity"))
    enriched = spine.join(added, "id", "left").withColumn(referenced, united).withColumn("capacity", size).withColumn("fueltype", F.coalesce("fueltype", "_f"))
    return enriched.select(*columns).unionByName(new.withColumn(referenced, F.array("id")).select(*columns))


def eligible(plants: DataFrame, least_mw: float = 1.0, least_plants: int = 3) -> DataFrame:
    """Located plants of cluster fuels and enough capacity, of fuel and technology pairs with enough plants."""
    fit = plants.filter((F.col("capacity") >= least_mw) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("fueltype").isin(CLUSTER_FUELS))
    fit = fit.withColumn("technology", F.coalesce("technology", F.lit("")))
    enough = fit.groupBy("fueltype", "technology").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_plants).drop("_n")
    return fit.join(F.broadcast(enough), ["fueltype", "technology"], "left_semi")  # one row for each fuel and technology


def cluster_rows(plants: DataFrame, components: DataFrame, least_plants: int = 3, first_id: int = 10_000_000) -> DataFrame:
    """One row a component of enough plants: a running id, fuel, technology, summed capacity, mean place, members, aliases."""
    joined = plants.join(components, "id")
    alias = plain_name(F.col("name"), any_case=False, underscores=False)
    summed = joined.groupBy("fueltype", "technology", "component").agg(
        F.count(F.lit(1)).alias("n_plants"), F.sum("capacity").alias("capacity"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("source_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(alias != "", alias))), ", ").alias("aliases"),
    ).filter(F.col("n_plants") >= least_plants)
    return numbered(summed, ["fueltype", "technology", "component"], "cluster_id", first_id)


def numbered(rows: DataFrame, order: list[str], name: str, first: int) -> DataFrame:
    """rows with running numbers from first on, in an order without ties.

    Rows are sorted in ranges; each range counts on from the number of rows before it, so no task sees them all. The
    ranges' sizes come to the driver, one number a range.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, at = F.lit(0).cast("long"), first
    for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        before = F.when(F.col("_range") == r["_range"], F.lit(at).cast("long")).otherwise(before)
        at += r.n
    own = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn(name, before + F.row_number().over(own) - 1).drop("_range")


def name_variants(*names: Column) -> Column:
    """The distinct names that aren't empty, sorted, as one cell."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull() & (n != "") & (n != "nan")))), " | ")


__all__ = ["FUEL_NAMES", "cluster_rows", "eligible", "farms", "filled_gaps", "first_listed", "name_variants", "numbered", "union_sorted", "with_gaps_filled"]
