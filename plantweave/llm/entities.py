"""What each typed name refers to: names restored, taken apart, their places put right, and told by the plant index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .mojibake import spoiled_values
from .names import ENERGY, NO_WORDS, Words, parse
from .variants import link_spellings
from .words import learned_words

_PART = "place string, cut boolean, nick boolean, type string, cluster boolean, block string, direction string, sections string, operator string"
_FIELDS = ["place", "cut", "nick", "type", "cluster", "block", "direction", "sections", "operator"]
#: The type of gas plants by technology in the plant index.
TECHNOLOGY = {"OCGT": "GTKW", "CCGT": "HKW"}


def _row(p) -> tuple:  # noqa: ANN001
    return tuple(getattr(p, f) for f in _FIELDS)


def parse_names(names: DataFrame, words: Words = NO_WORDS) -> DataFrame:
    """names: (name, text), text being the name as it is read. (name, n_parts, part, and the fields of a part)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text in zip(pdf.name, pdf.text, strict=True):
                parts = parse(text, words)
                rows += [(name, len(parts), i, *_row(p)) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["name", "n_parts", "part", *_FIELDS])

    return spread(names).mapInPandas(run, f"name string, n_parts int, part int, {_PART}")


def restored_names(rows: DataFrame) -> DataFrame:
    """(name, n, text) of the distinct names of rows (name): their number and the text with its encoding put right."""
    counted = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted)
    spoiled = spoiled_values(counted.select(F.col("name").alias("value"), "n")).drop("probability").withColumnRenamed("value", "name")
    return counted.join(spoiled, "name", "left").select("name", "n", F.coalesce("restored", "name").alias("text"))


def index_entities(index: DataFrame, words: Words = NO_WORDS) -> tuple[DataFrame, DataFrame]:
    """(plants, aliases) of the plant index.

    plants: one row an id: id, place, type (C: cluster, empty: unknown), block, direction, sections, capacity (null:
    unknown). aliases: (place, type, block) of a nickname or adjective with the id it means, where it means one only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                named = [parse(x, words) for x in [r.name, *(r.match_names or "").split(" | ")] if x]
                named = [p[0] for p in named if len(p) == 1]
                first = named[0] if named else None
                energy = ENERGY.get((r.fueltype or "").lower(), set())
                kind = next((p.type for p in named if p.type), "") or (next(iter(energy)) if len(energy) == 1 else TECHNOLOGY.get(r.technology or "", ""))
                if first is not None:
                    if r.entry_type == "cluster":
                        rows.append((r.id, False, first.place, "C", "", first.direction, first.sections, r.capacity or None))
                    else:
                        block = next((p.block for p in named if p.block), "")
                        rows.append((r.id, False, first.place, kind, block, "", "", r.capacity or None))
                for alias in (r.aliases or "").split(", "):
                    for p in parse(alias, words)[:1]:
                        rows.append((r.id, True, p.place, "C" if p.cluster else p.type, p.block, p.direction, p.sections, None))
            yield pd.DataFrame(rows, columns=["id", "alias", "place", "type", "block", "direction", "sections", "capacity"])

    columns = ["id", "entry_type", "name", "match_names", "aliases", "fueltype", "technology", "capacity"]
    told = cut_lineage(spread(index.select(*columns)).mapInPandas(run, "id string, alias boolean, place string, type string, block string, direction string, sections string, capacity double"))
    plants = told.filter(~F.col("alias")).drop("alias")
    alias = told.filter("alias AND place <> ''").groupBy("place", "type", "block").agg(F.min("id").alias("id"), F.max("id").alias("_last")).filter("id = _last").drop("_last")
    return plants, alias


def entity_key(place: Column, kind: Column, block: Column, direction: Column, sections: Column) -> Column:
    return F.when(kind == "C", F.concat_ws("|", place, kind, direction, sections)).otherwise(F.concat_ws("|", place, kind, block))


def name_entities(rows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, Words]:
    """(rows with their entity, plants, the words that were learned).

    rows: rec (any type, unique), name, matched_id (an id of the index, several joined by commas, or null). First
    result: rec, entity, n_parts, place, type, block, direction, sections (those of a single plant), operator.
    Second: the plants of the index with their entity, type completed. A name without anything to tell it by is
    its own folded text; null and blank names have no entity and come out with nulls.
    """
    rows = rows.select("rec", "name", "matched_id")
    names = cut_lineage(restored_names(rows))
    told = index.select(F.explode(F.array_append(F.split(F.coalesce("match_names", F.lit("")), r" \| "), F.col("name"))).alias("text"))
    words = learned_words(names, told, index.select(F.explode(F.split("aliases", ", ")).alias("text")).distinct())
    plants, aliases = index_entities(index, words)
    parts = cut_lineage(parse_names(names, words).join(names.select("name", "n"), "name"))

    # A type that the index doesn't tell is the one that most rows with its id tell.
    single = parts.filter("n_parts = 1 AND type <> ''").select("name", F.col("type").alias("told"))
    told = rows.filter(F.col("matched_id").isNotNull()).join(single, "name").groupBy("matched_id", "told").count()
    told = told.groupBy("matched_id").agg(F.max_by("told", F.struct("count", "told")).alias("told")).withColumnRenamed("matched_id", "id")
    plants = plants.join(told, "id", "left").withColumn("type", F.when(F.col("type") == "", F.coalesce("told", F.lit(""))).otherwise(F.col("type"))).drop("told")
    plants = cut_lineage(plants.withColumn("entity", entity_key(*[F.col(c) for c in ("place", "type", "block", "direction", "sections")])))

    known = plants.select(F.col("place").alias("text"), F.lit(True).alias("known")).unionByName(aliases.select(F.col("place").alias("text"), F.lit(True).alias("known")))
    texts = parts.select(F.col("place").alias("text"), "cut", F.lit(False).alias("known"), F.col("n").alias("weight"))
    texts = texts.unionByName(known.select("text", F.lit(False).alias("cut"), "known", F.lit(1).cast("long").alias("weight"))).filter("text <> ''")
    spelled = link_spellings(texts).withColumnRenamed("text", "place")

    own = parts.join(spelled, ["place", "cut"], "left").withColumn("place", F.coalesce("canonical", "place")).withColumn("type", F.when(F.col("cluster"), F.lit("C")).otherwise(F.col("type")))
    meant = plants.select("id", *[F.col(c).alias(f"m_{c}") for c in ("place", "type", "block", "direction", "sections")])
    by_alias = aliases.join(meant, "id").drop("id")
    own = own.join(by_alias, ["place", "type", "block"], "left")
    # A name without a type means the only plant of that place and block, if there is one only.
    alone = plants.filter("direction = '' AND sections = ''").groupBy("place", "block").agg(F.min("type").alias("only"), F.max("type").alias("_last")).filter("only = _last AND only <> ''").drop("_last")
    own = own.join(alone, ["place", "block"], "left")
    fill = F.when((F.col("type") == "") & (F.col("direction") == "") & (F.col("sections") == ""), F.col("only"))
    fields = {c: F.coalesce(f"m_{c}", *([fill] if c == "type" else []), c) for c in ("place", "type", "block", "direction", "sections")}
    sure = F.col("m_place").isNotNull() | (F.coalesce(F.col("is_known"), F.lit(False)) & (F.col("type") != ""))
    own = own.select("name", "n_parts", sure.alias("sure"), "operator", *[e.alias(c) for c, e in fields.items()])
    own = own.withColumn("entity", entity_key(*[F.col(c) for c in ("place", "type", "block", "direction", "sections")]))
    first = [F.first(c).alias(c) for c in ("place", "type", "block", "direction", "sections", "operator")]
    told_names = cut_lineage(own.groupBy("name").agg(F.max("n_parts").alias("n_parts"), F.min("sure").alias("sure"), F.array_join(F.array_sort(F.collect_set("entity")), " + ").alias("entity"), *first))

    by_id = plants.select(F.col("id").alias("matched_id"), *[F.col(c).alias(f"i_{c}") for c in ("entity", "place", "type", "block", "direction", "sections")])
    out = rows.join(told_names, "name", "left").join(by_id, "matched_id", "left")
    take = (F.col("n_parts") == 1) & ~F.col("sure") & F.col("i_entity").isNotNull()
    for c in ("entity", "place", "type", "block", "direction", "sections"):
        out = out.withColumn(c, F.when(take, F.col(f"i_{c}")).otherwise(F.col(c)))
    bare = F.regexp_replace(F.lower("name"), r"(?U)[^\w]+", " ")
    out = out.withColumn("entity", F.coalesce("entity", F.when(F.trim(bare) != "", F.concat(F.lit("text|"), F.trim(bare)))))
    return out.select("rec", "entity", "n_parts", "place", "type", "block", "direction", "sections", "operator"), plants, words


def linked_pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of rows (rec, entity) of one entity, smaller id first; rows without entity have none."""
    kept = cut_lineage(entities.filter(F.col("entity").isNotNull()).select("rec", "entity"))
    a, b = kept.select("entity", F.col("rec").alias("id_a")), kept.select("entity", F.col("rec").alias("id_b"))
    return a.join(b, "entity").filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")


