"""The whole way from an event log to resolved and located entries.

Each stage reads what the stages before it left open; results that several later stages read are written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import place_words, plain_name
from ..operators import decisions, entries, lookup, spatial
from ..operators.shortlist import core_queries, most_similar
from ..session import cut_lineage
from ..sources.resolvers import choose_best, chosen

RENEWABLE = ["Wind", "Solar", "Biogas", "Hydro", "Solid Biomass"]


@dataclass
class Resolved:
    """The stages' results; final has one row for each name of the log."""

    entries: DataFrame
    exact: DataFrame
    chosen: DataFrame
    clusters: DataFrame
    pending: DataFrame
    located: DataFrame
    bundles: DataFrame
    final: DataFrame


def shortlist(open_entries: DataFrame, plants: DataFrame, k: int = 20, least: int = 4) -> DataFrame:
    """The k most similar plants of each entry, of all that fit in fuel and size: (betroffene_anlage, cand_id, score, rank)."""
    name = F.col("betroffene_anlage")
    asked = core_queries(open_entries, name, name, F.col("primaerenergieart"), F.col("max_dispatched_mw"))
    return most_similar(asked, plants, k, least).select(F.col("entry").alias("betroffene_anlage"), F.col("id").alias("cand_id"), "score", "rank")


PLACES = "betroffene_anlage string, lat double, lon double"


def _by_location(open_names: DataFrame, places: DataFrame, plants: DataFrame) -> DataFrame:
    """Entries told by an outside location alone: the nearest plant within 5 km, of low confidence."""
    at = open_names.join(places, "betroffene_anlage")
    near = spatial.nearest_within(at, plants, "betroffene_anlage", "id", 5.0, inclusive=True)
    where = plants.select(F.col("id").alias("matched_id"), "lat", "lon")
    return near.select(F.col("q_id").alias("betroffene_anlage"), F.col("p_id").alias("matched_id"), F.lit("index").alias("id_source"), F.lit("location").alias("method"), F.lit("low").alias("confidence")).join(where, "matched_id")


def _pending_by_location(pending: DataFrame, places: DataFrame, plants: DataFrame) -> DataFrame:
    """Clusters whose members lie scattered: the renewable plants within 10 km of an outside location."""
    around = spatial.gathered(pending.select("betroffene_anlage").join(places, "betroffene_anlage"), plants.filter(F.col("fueltype").isin(RENEWABLE)), "betroffene_anlage", "id", 10.0, "capacity")
    return around.select(F.col("q_id").alias("betroffene_anlage"), "matched_id", F.lit("index").alias("id_source"), F.lit("cluster_location").alias("method"), F.lit("medium").alias("confidence"), "lat", "lon")


def _finished(told: DataFrame, merged: DataFrame, places: DataFrame) -> DataFrame:
    """Every entry with its match, missing coordinates filled in, and how far an outside location lies from it."""
    filled = decisions.filled_places(decisions.onto_base(told, merged).withColumn("coord_source", F.lit(None).cast("string")), places, "betroffene_anlage")
    filled = cut_lineage(filled)
    single = filled.filter("matched_id IS NOT NULL AND lat IS NOT NULL AND coord_source = 'index' AND entry_type <> 'multi_plant'").select("betroffene_anlage", "lat", "lon")
    return filled.join(spatial.location_confirmed(single, places, "betroffene_anlage"), "betroffene_anlage", "left")


def resolve(events: DataFrame, index: DataFrame, registry: DataFrame, places: DataFrame | None = None) -> Resolved:
    """events: an export. index, registry: the plant index and the registry's lookup. places: outside locations, one row a name
    (betroffene_anlage, lat, lon); none by default.

    Exact names first, then the best of a shortlist, clusters by the place in their name or else around their location, entries
    still open by their location, bundles by their parts. Later stages win. Coordinates that are missing come from places, the
    others are held against them.
    """
    places = events.sparkSession.createDataFrame([], PLACES) if places is None else places.select("betroffene_anlage", "lat", "lon")
    told = cut_lineage(entries.entries(events))
    plants = index.filter("entry_type = 'individual'")
    names = lookup.name_index(index, "id", F.split("match_names", r" \| "), "index").unionByName(lookup.name_index(registry, "mastr_id", F.array("anzeigename"), "bnetza"))
    matchable = told.filter(F.col("entry_type").isin("individual", "cluster"))
    hits = lookup.unique_hits(matchable, names).filter("candidate IS NOT NULL")
    where = index.select(F.col("id").alias("matched_id"), "lat", "lon")
    exact = hits.select("betroffene_anlage", F.col("candidate").alias("matched_id"), "id_source", F.lit("exact").alias("method"), F.lit("high").alias("confidence")).join(where, "matched_id", "left")
    exact = cut_lineage(exact)

    rest = lookup.open_entries(told.filter("entry_type = 'individual'"), exact)
    listed = cut_lineage(shortlist(rest, plants))
    picks = chosen(choose_best(listed, "betroffene_anlage", "cand_id", "score"), listed, "betroffene_anlage", "cand_id")
    best = picks.select("betroffene_anlage", F.col("cand_id").alias("matched_id"), F.when(F.col("cand_id").isNotNull(), "index").alias("id_source"), F.lit("chooser").alias("method"), "confidence").join(where, "matched_id", "left")

    words = plants.filter(F.col("fueltype").isin(RENEWABLE)).select("id", "lat", "lon", "capacity", F.explode(F.array_distinct(F.split(plain_name(F.col("name")), " "))).alias("w")).filter(F.length("w") >= 4)
    asked = told.filter("entry_type = 'cluster'").select("betroffene_anlage", F.explode(F.array_distinct(place_words(F.col("betroffene_anlage")))).alias("w"))
    gathered = cut_lineage(asked.join(words, "w").select("betroffene_anlage", "id", "lat", "lon", "capacity").distinct().withColumn("key", F.struct("betroffene_anlage", "id")))
    balls = cut_lineage(spatial.densest_balls(gathered, "betroffene_anlage", "key"))
    members = spatial.ball_members(gathered, balls.filter("coherent"), "betroffene_anlage", "key")
    summed = spatial.member_summary(members.select("betroffene_anlage", F.col("id").alias("member"), "lat", "lon", F.col("capacity").alias("mw")), "betroffene_anlage")
    clusters = summed.withColumn("id_source", F.lit("index")).withColumn("method", F.lit("cluster_name")).withColumn("confidence", F.lit("high"))
    pending = balls.filter("NOT coherent").select("betroffene_anlage", "gathered", "core")

    around = _pending_by_location(pending, places, plants)
    so_far = cut_lineage(decisions.merged([exact, best, around, clusters]))
    unmatched = told.filter("entry_type = 'individual'").join(so_far.filter("matched_id IS NOT NULL AND confidence <> 'low'").select("betroffene_anlage"), "betroffene_anlage", "left_anti")
    located = cut_lineage(_by_location(unmatched.select("betroffene_anlage"), places, plants))
    merged = cut_lineage(decisions.merged([so_far, located]))
    of_index = index.select(F.col("id").alias("matched_id"), F.col("name").alias("matched_name"), "capacity", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    single = merged.join(of_index, "matched_id").select("betroffene_anlage", "matched_id", "matched_name", "capacity", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    bundles = decisions.composed(told.filter("entry_type = 'multi_plant'").select("betroffene_anlage"), single)
    bundles = cut_lineage(bundles.withColumn("id_source", F.lit("index")).withColumn("method", F.lit("members")))
    final = _finished(told, decisions.merged([merged, bundles]), places)
    return Resolved(told, exact, best, clusters, pending, located, bundles, final)
