"""Volumes of events by day, year and category, and the answers of the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.days import local_day, written_moment, written_year
from ..functions.figures import balance, marker_radius
from ..functions.text import decimal_comma, filled, stripped
from .registry import numbered

# The categories of volumes, and the types of entries that stand for no single plant.
CATEGORIES = ["matched high", "matched medium", "matched low", "unmatched", "aggregate", "out of scope"]
AGGREGATES = ["control_reserve", "substation", "regional_renewable", "countertrade", "emergency", "foreign"]


def exact_sum(c: Column | str) -> Column:
    """A sum of volumes that doesn't depend on the order in which partitions arrive: of whole millionths."""
    return F.sum(F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")) / 1e6


def volumes(events: DataFrame) -> DataFrame:
    """name, day, year, mwh, inc, dec of calls with a day and a volume.

    inc and dec hold the volume of calls whose direction says up or down, found by the part of the word that every
    spelling shares.
    """
    # inline() works each field out once; a filter over plain columns would be pushed below and repeat them.
    wall = written_moment(F.col("beginn_datum"), F.col("beginn_uhrzeit"))
    mwh = F.abs(decimal_comma(F.col("gesamte_arbeit_mwh")))
    direction = F.lower(F.coalesce("richtung", F.lit("")))
    told = F.struct(filled(F.col("betroffene_anlage")).alias("name"), wall.alias("wall"), F.col("zeitzone_von").alias("zone"), written_year(F.col("beginn_datum")).alias("year"), mwh.alias("mwh"), F.contains(direction, F.lit("erh")).alias("up"), F.contains(direction, F.lit("reduzieren")).alias("down"))
    rows = events.select(F.inline(F.array(told))).filter("mwh IS NOT NULL AND wall IS NOT NULL")
    dayed = rows.select("name", "year", "mwh", "up", "down", F.explode(F.array(local_day(F.col("wall"), F.col("zone")))).alias("day")).filter("day IS NOT NULL")
    return dayed.select("name", "day", "year", "mwh", F.when(F.col("up"), F.col("mwh")).otherwise(0.0).alias("inc"), F.when(F.col("down"), F.col("mwh")).otherwise(0.0).alias("dec"))


def map_category(entry: Column, lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), "mapped").when(stripped(F.coalesce(entry, F.lit(""))) == "countertrade", "boerse").otherwise("not_identified")


def match_category(known: Column, matched: Column, confidence: Column, entry: Column) -> Column:
    """One of CATEGORIES."""
    return F.when(~known, "out of scope").when(matched, F.concat(F.lit("matched "), confidence)).when(entry.isin(AGGREGATES), "aggregate").otherwise("unmatched")


def daily(df: DataFrame, *keys: str) -> DataFrame:
    """inc and dec a day and key, rounded to thousandths."""
    return df.groupBy(*keys, "day").agg(F.round(exact_sum("inc"), 3).alias("inc"), F.round(exact_sum("dec"), 3).alias("dec"))


def category_totals(df: DataFrame, domain: Sequence[str] = CATEGORIES) -> DataFrame:
    """(category, mwh) of every category of the domain, 0 where there is nothing."""
    spark = df.sparkSession
    base = spark.createDataFrame([(c,) for c in domain], "category string")
    return F.broadcast(base).join(df.groupBy("category").agg(exact_sum("mwh").alias("mwh")), "category", "left").select("category", F.coalesce("mwh", F.lit(0.0)).alias("mwh"))


def year_table(df: DataFrame, domain: Sequence[str] = CATEGORIES) -> DataFrame:
    """A row a year with a column for each category of the domain, 0 where there is nothing."""
    return df.groupBy("year").pivot("category", [*domain]).agg(exact_sum("mwh")).na.fill(0.0)


def row_shares(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as percent of their row's sum."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return table.select("year", *[(100 * F.col(c) / F.nullif(total, F.lit(0.0))).alias(c) for c in columns])


def key_figures(df: DataFrame) -> DataFrame:
    """Shares of volume: matched of all, aggregates of all, matched of what isn't aggregate."""
    matched = exact_sum(F.when(F.startswith("category", F.lit("matched")), F.col("mwh")).otherwise(0.0))
    aggregate = exact_sum(F.when(F.col("category") == "aggregate", F.col("mwh")).otherwise(0.0))
    summed = df.agg(exact_sum("mwh").alias("t"), matched.alias("m"), aggregate.alias("a"))
    return summed.select(F.col("t").alias("total_mwh"), (100 * F.col("m") / F.col("t")).alias("matched_pct"), (100 * F.col("a") / F.col("t")).alias("aggregate_pct"), (100 * F.col("m") / (F.col("t") - F.col("a"))).alias("attributable_pct"))


def largest(df: DataFrame, keys: list[str], k: int = 15) -> DataFrame:
    """The k groups of most volume, ties by key."""
    return df.groupBy(*keys).agg(exact_sum("mwh").alias("mwh")).orderBy(F.desc("mwh"), *keys).limit(k)


def day_axis(df: DataFrame) -> DataFrame:
    """(day, i): every day from the first to the last, numbered from 0 on."""
    ends = df.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL")
    return ends.select(F.posexplode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("i", "day"))


def series(daily_rows: DataFrame, key: str = "name") -> DataFrame:
    """(key, series): a map from day to inc and dec."""
    entry = F.struct(F.date_format("day", "yyyy-MM-dd").alias("k"), F.array("inc", "dec").alias("v"))
    return daily_rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("series"))


def window_view(daily_rows: DataFrame, first_day: str, last_day: str, confidences: Sequence[str] | None = None, key: str = "name") -> DataFrame:
    """Each key's volume in a window of days, with the radius and colour of its marker, and whether the filter shows it.

    daily_rows: key, confidence, day, inc, dec. The radius' reference is the largest whole-period total as a daily
    rate times the window's length, so it depends on the length only.
    """
    whole = daily_rows.groupBy(key).agg((exact_sum("inc") + exact_sum("dec")).alias("_t")).agg(F.max("_t").alias("_most"))
    span = daily_rows.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("_days"))
    scale = whole.crossJoin(span).select((F.col("_most") / F.col("_days")).alias("_rate"))  # one row with one row
    inside = daily_rows.filter(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    summed = inside.groupBy(key, "confidence").agg(F.round(exact_sum("inc"), 3).alias("inc"), F.round(exact_sum("dec"), 3).alias("dec"))
    length = F.datediff(F.lit(last_day).cast("date"), F.lit(first_day).cast("date")) + 1
    shown = F.col("confidence").isin([*confidences]) if confidences is not None else F.lit(True)
    return summed.crossJoin(F.broadcast(scale)).select(key, "inc", "dec", shown.alias("shown"), marker_radius(F.col("inc") + F.col("dec"), F.col("_rate") * length).alias("radius"), balance(F.col("inc"), F.col("dec")).alias("balance"))


def type_shown(entry: Column, confidence: Column, plants: bool = True, clusters: bool = True, confidences: Sequence[str] = ("high", "medium", "low", "none")) -> Column:
    """Whether two switches, for plants and for clusters, and a set of confidences let an entry be seen."""
    return F.coalesce(F.when(entry == "cluster", F.lit(clusters)).otherwise(F.lit(plants)) & confidence.isin([*confidences]), F.lit(False))


def window_shares(daily_rows: DataFrame, shown: Column, first_day: str, last_day: str, key: str = "name") -> DataFrame:
    """(key, mwh, pct, place) of the keys that are shown, the largest first: pct of all volume in the window, hidden keys' too.

    daily_rows: key, day, inc, dec and what shown reads; place counts from 1, ties by key.
    """
    inside = daily_rows.filter(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    summed = inside.groupBy(key, shown.alias("_shown")).agg(exact_sum(F.col("inc") + F.col("dec")).alias("mwh"))
    total = summed.agg(exact_sum("mwh").alias("_all"))  # one row
    out = summed.filter("_shown").crossJoin(F.broadcast(total)).select(key, "mwh", (100 * F.col("mwh") / F.nullif(F.col("_all"), F.lit(0.0))).alias("pct"))
    return numbered(out.withColumn("_less", -F.col("mwh")), ["_less", key], "place", 1).drop("_less").orderBy("place")


def shares_of_total(df: DataFrame, by: str) -> DataFrame:
    """(by, mwh, pct) of the whole, the largest first. The total is taken over the groups."""
    grouped = df.groupBy(by).agg(exact_sum("mwh").alias("mwh"))
    return grouped.withColumn("pct", 100 * F.col("mwh") / F.sum("mwh").over(Window.partitionBy())).orderBy(F.desc("mwh"), by)
