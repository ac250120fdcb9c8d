"""Outside resolvers behind one interface each, with defaults that need no network.

A live resolver implements resolve() over small batches and is called from mapInPandas, so that its calls are spread
over the executors; a recorded one is a table. Whatever a chooser picks is held against the shortlist afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators.lookup import guarded

GEOCODED = "name string, lat double, lon double"


class Locator(Protocol):
    """Coordinates of names; names that it doesn't answer are left out."""

    def resolve(self, names: list[str]) -> list[tuple[str, float, float]]: ...


def locate(names: DataFrame, locator: Locator, batch: int = 40) -> DataFrame:
    """(name, lat, lon): distinct names that aren't blank, in batches; answers count by the name that they repeat.

    Answers for names that weren't asked are dropped, coordinates rounded to four places, a failed batch gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = pdf.name.tolist()
            for a in range(0, len(asked), batch):
                part = asked[a : a + batch]
                try:
                    answers = {n: (lat, lon) for n, lat, lon in locator.resolve(part) if lat is not None and lon is not None}
                except Exception:  # noqa: BLE001 - a resolver's failure leaves its names open
                    answers = {}
                yield pd.DataFrame([(n, round(answers[n][0], 4), round(answers[n][1], 4)) for n in part if n in answers], columns=["name", "lat", "lon"])

    distinct = names.select(filled(F.col("name")).alias("name")).filter("name IS NOT NULL").distinct()
    return distinct.mapInPandas(run, GEOCODED)


def located_by_table(names: DataFrame, known: DataFrame) -> DataFrame:
    """The recorded answers (name, lat, lon) for the distinct names."""
    return names.select(filled(F.col("name")).alias("name")).distinct().join(known, "name").select("name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


def choose_best(shortlist: DataFrame, entry: str, candidate: str, score: str, high: float = 95.0, medium: float = 88.0, low: float = 80.0) -> DataFrame:
    """The default chooser: the best-scored candidate, with a confidence by thresholds; null under the lowest one."""
    best = shortlist.groupBy(entry).agg(F.min_by(F.struct(candidate, score), F.struct(-F.col(score), F.col(candidate))).alias("_b"))
    s = F.col(f"_b.{score}")
    level = F.when(s >= high, "high").when(s >= medium, "medium").when(s >= low, "low").otherwise("none")
    return best.select(entry, F.when(s >= low, F.col(f"_b.{candidate}")).alias(candidate), level.alias("confidence"))


def chosen(picks: DataFrame, shortlist: DataFrame, entry: str, candidate: str) -> DataFrame:
    """Picks after the guard: an id that the shortlist doesn't hold is a declined entry of confidence none."""
    held = guarded(picks, shortlist, entry, candidate)
    return held.withColumn("confidence", F.when(F.col(candidate).isNull(), "none").otherwise(F.col("confidence")))


def prompt_lines(shortlist: DataFrame, entry: str) -> DataFrame:
    """(entry, prompt): the text that describes an entry's candidates to a chooser, in the order of their rank."""
    line = F.format_string("  %s | %s | %s | %s MW", "cand_id", F.substring("cand_name", 1, 45), F.coalesce("cand_fueltype", F.lit("")), F.col("cand_capacity").cast("string"))
    rows = shortlist.groupBy(entry).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return rows.select(entry, F.concat(F.col(entry), F.lit("\n"), F.array_join(F.col("_l.line"), "\n")).alias("prompt"))
