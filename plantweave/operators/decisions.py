"""Results of several resolvers merged, composed, filled up and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import listed_parts
from .entries import last_wins

#: What a stage tells of an entry.
MATCH = ["matched_id", "id_source", "method", "confidence", "lat", "lon"]


def merged(stages: list[DataFrame], key: str = "betroffene_anlage", columns: list[str] = MATCH) -> DataFrame:
    """One row a key from the stages in order of their precedence, the last one that has the key winning.

    Columns that a stage lacks are null in its rows; of several rows of a key in one stage the smallest as JSON wins.
    """
    return last_wins([s.select(key, *[F.col(c) if c in s.columns else F.lit(None).alias(c) for c in columns]) for s in stages], key)


def onto_base(base: DataFrame, matches: DataFrame, key: str = "betroffene_anlage") -> DataFrame:
    """Every row of the base with its match or nulls. A key that matches hold twice is an error when it runs, so the number of rows stays."""
    once = matches.groupBy(key).agg(*[F.first(c).alias(c) for c in matches.columns if c != key], F.count(F.lit(1)).alias("_n"))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several matches of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return base.join(once.filter(sure).drop("_n"), key, "left")


def composed(bundles: DataFrame, matches: DataFrame, key: str = "betroffene_anlage") -> DataFrame:
    """Bundles told by their parts' own matches, in the order in which they are listed.

    matches: one row a name: matched_id, matched_name, capacity, lat, lon. Bundles of which no part is matched are left
    out. Parts that are matched to one plant count as often as they are listed.
    """
    parts = bundles.select(key, F.posexplode(listed_parts(F.col(key))).alias("_i", "_part"))
    matched = matches.filter("matched_id IS NOT NULL AND matched_id <> ''").select(F.col(key).alias("_part"), "matched_id", "matched_name", "capacity", "lat", "lon")
    members = parts.join(matched, "_part", "left")
    listed = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("matched_id").isNotNull(), F.struct("_i", F.col(c).alias("x"))))), lambda s: s["x"]), sep)
    out = members.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_parts"), F.count("matched_id").alias("n_matched"), listed("matched_id", ",").alias("matched_id"),
        listed("matched_name", " + ").alias("matched_name"), F.sum("capacity").alias("capacity_mw"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"),
    )
    return out.filter("n_matched > 0").withColumn("confidence", F.when(F.col("n_matched") == F.col("n_parts"), "high").otherwise("medium"))


def filled_places(rows: DataFrame, located: DataFrame, key: str) -> DataFrame:
    """Null coordinates filled from located (key, lat, lon); coord_source tells where they come from."""
    other = located.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    lacks = F.col("lat").isNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    joined = rows.join(other, key, "left")
    source = F.when(lacks, "geocode").when(F.col("lat").isNotNull(), F.coalesce("coord_source", F.lit("index"))).otherwise("none")
    return joined.withColumn("coord_source", source).withColumn("lon", F.when(lacks, F.col("_lon")).otherwise(F.col("lon"))).withColumn("lat", F.when(lacks, F.col("_lat")).otherwise(F.col("lat"))).drop("_lat", "_lon")


def located_verdict(had_plant: Column, had_place: Column, km: Column, limit: float = 5.0) -> Column:
    """What an outside location says of a plant: agree, disagree, nearby or alone."""
    near = F.coalesce(km <= limit, F.lit(False))
    return F.when(had_plant & had_place, F.when(near, "agree").otherwise("disagree")).otherwise(F.when(near, "nearby").otherwise("alone"))


def verdict_confidence(verdict: Column) -> Column:
    return F.when(verdict == "agree", "high").when(verdict == "alone", "none").otherwise("low")


def verdict_reason(verdict: Column, title: Column, km: Column, limit: float = 5.0) -> Column:
    """One sentence for a verdict."""
    return (
        F.when(verdict == "agree", F.format_string("chooser and %s agree within %.0f km", title, km))
        .when(verdict == "disagree", F.format_string("chooser and %s disagree", title))
        .when(verdict == "nearby", F.format_string("nearest plant to %s within %.0f km", title, km))
        .otherwise(F.format_string(f"%s located, no plant within {limit:.0f} km", title))
    )


def reason_checked(reason: Column, confidence: Column, coord_check: Column, km: Column) -> Column:
    """A reason with the distance appended where coordinates disagree and the match isn't of high confidence."""
    doubtful = (coord_check == "disagree") & (F.coalesce(confidence, F.lit("none")) != "high")
    return F.when(doubtful, F.concat(F.coalesce(reason, F.lit("")), F.format_string("; coordinates %.0f km apart", km))).otherwise(reason)


def check(df: DataFrame, **conditions: Column) -> DataFrame:
    """(check, violations): the rows for which a condition isn't true, null included; one pass for all conditions."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in conditions]))
    return counted.select(pairs.alias("_p")).select("_p.*")
