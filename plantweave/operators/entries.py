"""Event logs: sources united, and one row a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decimal_comma, entry_type, filled, listed_parts, stripped, told_technology


def united(*sources: DataFrame, distinct: bool = True) -> DataFrame:
    """All rows of the sources; repeated rows are dropped within a source, not across. Missing columns are null."""
    parts = [s.dropDuplicates() if distinct else s for s in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def smallest_mode(c: Column) -> Column:
    """An aggregate: the commonest value, of several the smallest; the empty text if there is none."""
    return F.coalesce(F.mode(c, deterministic=True), F.lit(""))


def entries(events: DataFrame, name: str = "betroffene_anlage", energy: str = "primaerenergieart", power: str = "maximale_leistung_mw", operator: str = "anweisender_uenb") -> DataFrame:
    """One row for each name of an event log: its commonest energy, whether that varies, its largest power, the
    operators, the number of events, its type and the technology that it tells. Blank names are left out.
    """
    kinds = filled(F.col(energy))
    named = events.select(filled(F.col(name)).alias("betroffene_anlage"), kinds.alias("_e"), decimal_comma(F.col(power)).alias("_p"), filled(F.col(operator)).alias("_o")).filter("betroffene_anlage IS NOT NULL")
    reduced = named.groupBy("betroffene_anlage").agg(
        smallest_mode(F.col("_e")).alias("primaerenergieart"),
        (F.count_distinct("_e") > 1).alias("energy_conflict"),
        F.max("_p").alias("max_dispatched_mw"),
        F.concat_ws(",", F.array_sort(F.collect_set("_o"))).alias("tsos"),
        F.count(F.lit(1)).alias("n_events"),
    )
    # The rules run once a name, not once an event.
    return reduced.withColumn("entry_type", entry_type(F.col("betroffene_anlage"))).withColumn("name_technology", told_technology(F.col("betroffene_anlage")))


def parts_without_entry(table: DataFrame, name: str = "betroffene_anlage") -> DataFrame:
    """(n_parts, n_missing): distinct parts of the names that list several, and those that are no name themselves."""
    names = table.select(stripped(F.col(name)).alias("part")).distinct()
    parts = table.select(F.explode(listed_parts(F.col(name))).alias("part")).distinct()
    joined = parts.join(names.withColumn("_own", F.lit(1)), "part", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("_own").isNull()).alias("n_missing"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), the commonest first, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def last_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key, from the last source that holds it; of several rows there the smallest as a struct."""
    ranked = united(*[s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)], distinct=False)
    rest = [c for c in ranked.columns if c not in (key, "_rank")]
    row = F.struct(*rest)
    best = ranked.groupBy(key).agg(F.min_by(row, F.struct(-F.col("_rank"), F.to_json(row))).alias("_row"))
    return best.select(key, "_row.*")


def first_by(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The values of each group's first row in an explicit order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(order, *values)).alias("_row")).select(*keys, "_row.*")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first): the distinct values of a column with the least order that has each, as they come up; null is none."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
