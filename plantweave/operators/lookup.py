"""Names to identifiers by equality, and the limits on candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fuels_allowed, plain_name


def name_index(df: DataFrame, key: str, names: Column, source: str) -> DataFrame:
    """(norm, candidate, id_source): every name variant of an array of names, normalised, with its id."""
    exploded = df.select(F.col(key).alias("candidate"), F.explode(names).alias("_v"))
    return exploded.select(plain_name(F.col("_v")).alias("norm"), "candidate", F.lit(source).alias("id_source")).filter("norm <> ''").distinct()


def bridged(registry_names: DataFrame, crossing: DataFrame) -> DataFrame:
    """A registry's name index with those ids replaced that another index holds.

    crossing: (candidate, other): of several others of one candidate the smallest counts; with a column place the one
    that is listed first.
    """
    listed = F.struct("place", "other") if "place" in crossing.columns else F.struct("other")
    one = crossing.groupBy("candidate").agg(F.min_by("other", listed).alias("other"))
    joined = registry_names.join(one, "candidate", "left")
    return joined.select("norm", F.coalesce("other", "candidate").alias("candidate"), F.when(F.col("other").isNotNull(), "index").otherwise(F.col("id_source")).alias("id_source")).distinct()


def unique_hits(queries: DataFrame, index: DataFrame, name: str = "betroffene_anlage") -> DataFrame:
    """(name, candidate, id_source, n_candidates) of queries with a hit: candidate is null where several are hit.

    The index is reduced to one row a normal form before it meets the queries, so a form that many ids share, or many
    queries ask for, never makes all their pairs.
    """
    forms = index.groupBy("norm").agg(F.count_distinct("candidate", "id_source").alias("n_candidates"), F.min("candidate").alias("_c"), F.min("id_source").alias("_s"))
    asked = queries.select(name, plain_name(F.col(name)).alias("norm")).filter("norm <> ''")
    sure = F.col("n_candidates") == 1
    return asked.join(forms, "norm").select(name, F.when(sure, F.col("_c")).alias("candidate"), F.when(sure, F.col("_s")).alias("id_source"), "n_candidates")


def open_entries(entries: DataFrame, *done: DataFrame, name: str = "betroffene_anlage") -> DataFrame:
    """Entries without a row in any table of finished ones."""
    for d in done:
        entries = entries.join(d.select(name).distinct(), name, "left_anti")
    return entries


def fits_fuel(energy: Column, fuel: Column) -> Column:
    allowed = fuels_allowed(energy)
    return allowed.isNull() | F.coalesce(F.array_contains(allowed, fuel), F.lit(False))


def fits_power(dispatched: Column, capacity: Column, tolerance: float = 0.3) -> Column:
    """Whether a plant is large enough for what was dispatched; unknown sizes (null or 0) fit."""
    size = F.coalesce(capacity, F.lit(0.0))
    return dispatched.isNull() | (size == 0) | (size >= dispatched * (1 - tolerance))


def top_k(pairs: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of a group with their rank from 1 on; ties by the column tie."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def guarded(picks: DataFrame, shortlist: DataFrame, entry: str, candidate: str) -> DataFrame:
    """Picks with an id that isn't on the entry's own shortlist set to null, and whether that was done."""
    listed = shortlist.select(entry, candidate).distinct().withColumn("_listed", F.lit(True))
    joined = picks.join(listed, [entry, candidate], "left")
    ok = F.coalesce("_listed", F.lit(False))
    rest = [c for c in picks.columns if c not in (entry, candidate)]
    return joined.select(entry, F.when(ok, F.col(candidate)).alias(candidate), *rest, (F.col(candidate).isNotNull() & ~ok).alias("rejected"))
