"""The queries of the general training-data problems (timestamps, nearby points)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import instant_ms, is_plain
from ..operators.proximity import rows_within
from ..session import table


def p2_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with its start in milliseconds since 1970 UTC, null where its fields don't give exactly one."""
    fields = [F.col(c) for c in ("beginn_datum", "beginn_uhrzeit", "zeitzone_von")]
    return table(spark, sf_dir, "build_data").select("row_id", instant_ms(*fields).alias("start_ms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose start isn't in the plain form already and is exactly one instant."""
    fields = [F.col(c) for c in ("beginn_datum", "beginn_uhrzeit", "zeitzone_von")]
    calls = table(spark, sf_dir, "build_data").select("row_id", *fields).filter(~is_plain(*fields))
    return calls.select("row_id", instant_ms(*fields).alias("start_ms")).filter(F.col("start_ms").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of matches_wikipedia and matches_cluster at most 5 km apart."""
    wiki, cluster = table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "matches_cluster")
    return rows_within(wiki, cluster, "wiki_id", "cluster_id", 5.0, swapped=True).select("wiki_id", "cluster_id")


_UPRIGHT = """SELECT {key}, greatest(lat, lon) AS lat, least(lat, lon) AS lon FROM {table}
WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0)"""

SQL = {
    "p3_found": f"""
WITH w AS ({_UPRIGHT.format(key="wiki_id", table="matches_wikipedia")}),
     c AS ({_UPRIGHT.format(key="cluster_id", table="matches_cluster")})
SELECT wiki_id, cluster_id FROM w, c
WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - w.lat) / 2), 2)
  + cos(radians(w.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - w.lon) / 2), 2)))) <= 5.0""",
}

QUERIES = {"p2_found": p2_found, "p2_instants": p2_instants, "p3_found": p3_found}
