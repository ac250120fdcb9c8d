"""The queries of this subpackage and those of their SQL equivalents that DuckDB can run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .entities import linked_pairs, name_entities
from .formatting import copies, records
from .linkage import confidence, label_reliability, match_entities
from .mixture import mix
from .mojibake import spoiled_rows
from .reading import fit_labels, reading_level
from .tokens import encode_texts

_P1 = {"row_id": "match_id", "same": ["entry_type", "matched_id", "id_source"], "texts": ["betroffene_anlage", "matched_name"]}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies in matches_exact that differ in formatting only, each with the smallest match_id of its record."""
    return copies(table(spark, sf_dir, "matches_exact"), **_P1)


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record of matches_exact with the number of its copies."""
    return records(table(spark, sf_dir, "matches_exact"), **_P1)


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, exact = table(spark, sf_dir, "build_data"), table(spark, sf_dir, "matches_exact")
    return spoiled_rows([("build_data", calls, "row_id", "richtung"), ("matches_exact", exact, "match_id", "betroffene_anlage")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose direction or plant name is spoiled by a wrong encoding."""
    return _p4(spark, sf_dir).select("table_name", "rec_id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the text as it most likely was."""
    return _p4(spark, sf_dir)


def _p5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that name one plant (rec, entity), the plants of the index, and the pairs of entities and registry rows."""
    exact = table(spark, sf_dir, "matches_exact").select(F.struct(F.lit("exact").alias("rec_kind"), F.col("match_id").alias("rec_id")).alias("rec"), F.col("betroffene_anlage").alias("name"), "matched_id")
    cluster = table(spark, sf_dir, "matches_cluster").select(F.struct(F.lit("cluster").alias("rec_kind"), F.col("cluster_id").alias("rec_id")).alias("rec"), F.col("betroffene_anlage").alias("name"), F.lit(None).cast("string").alias("matched_id"))
    rows, plants, words = name_entities(exact.unionByName(cluster), table(spark, sf_dir, "candidate_index"))
    rows = cut_lineage(rows.filter("n_parts = 1"))
    # Plants of the index without a row take part, so that a record isn't given to the next best plant.
    fields = ["entity", "place", "type", "block", "direction", "sections"]
    known = plants.select(*fields, "capacity").unionByName(rows.select(*fields, F.lit(None).cast("double").alias("capacity")))
    entities = known.groupBy("entity").agg(*[F.first(c).alias(c) for c in fields[1:]], F.max("capacity").alias("capacity"))
    return rows, plants, match_entities(entities, table(spark, sf_dir, "bnetza_lookup"), words)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of matches_exact and matches_cluster with the registry rows that describe the same plant."""
    rows, _, pairs = _p5(spark, sf_dir)
    kept = pairs.filter("confidence <> 'none'").select("entity", "mastr_id")
    return rows.select("rec.rec_kind", "rec.rec_id", "entity").join(kept, "entity").drop("entity")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs and less likely ones, with the probability that they are one plant and a confidence.

    The confidence of a row that has one of its own (matches_cluster.confidence) also tells how often rows of that
    confidence lie where the plant lies.
    """
    rows, plants, pairs = _p5(spark, sf_dir)
    own = table(spark, sf_dir, "matches_cluster").select(F.struct(F.lit("cluster").alias("rec_kind"), F.col("cluster_id").alias("rec_id")).alias("rec"), F.col("confidence").alias("label"), "lat", "lon")
    places = table(spark, sf_dir, "candidate_index").select("id", "lat", "lon")
    labelled = cut_lineage(rows.select("rec", "entity").join(own.hint("merge"), "rec"))
    trust = label_reliability(labelled, plants.select("id", "entity").join(places, "id"))
    share = F.lit(1.0)
    for label, r in trust.items():
        share = F.when(F.col("_label") == label, r).otherwise(share)
    told = rows.select("rec", "entity").join(labelled.select("rec", F.coalesce("label", F.lit("unknown")).alias("_label")).hint("merge"), "rec", "left")
    joined = told.join(pairs, "entity").withColumn("sure", F.col("probability") * share)
    return joined.select("rec.rec_kind", "rec.rec_id", "mastr_id", "score", "probability", confidence(F.col("sure")).alias("confidence"))


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = table(spark, sf_dir, "matches_exact").select(F.col("match_id").alias("rec"), F.col("betroffene_anlage").alias("name"), "matched_id")
    pending = table(spark, sf_dir, "matches_cluster_pending").select(F.col("pending_id").alias("rec"), F.col("betroffene_anlage").alias("name"), F.lit(None).cast("string").alias("matched_id"))
    return name_entities(exact.unionByName(pending), table(spark, sf_dir, "candidate_index"))[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of matches_exact and matches_cluster_pending that name one plant."""
    return linked_pairs(_p6(spark, sf_dir))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with what it names."""
    return _p6(spark, sf_dir).select(F.col("rec").alias("rec_id"), "entity", "n_parts")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_chunked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids with chunks so small that most documents are cut and stitched."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", chunk=600, overlap=120)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mixture that each source reaches."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_clamped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture 1.6 times as large, for which scarce sources are clamped at max_repeats and their rest shared out."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), stretch=1.6)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need specialist, academic or legal training: level 4 or 5."""
    return p9_levels(spark, sf_dir).filter("reading_level >= 3.5").select("doc_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document, null where it has none."""
    documents = table(spark, sf_dir, "documents")
    ranker = fit_labels(documents, table(spark, sf_dir, "reading_labels"))
    return documents.select("doc_id", reading_level(F.col("text"), ranker).alias("reading_level"))


_KEYED = r"""
WITH words AS (
  SELECT match_id, entry_type, matched_id, id_source, list_transform([betroffene_anlage, matched_name],
    lambda x: coalesce('=' || array_to_string(list_sort(regexp_extract_all(replace(replace(nfc_normalize(lower(nfc_normalize(
      regexp_replace(x, '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}]', '', 'g')))), 'ß', 'ss'), 'ﬂ', 'fl'),
      '(?:\pL\pM*)+|\pN+')), ' '), '')) AS fields
  FROM matches_exact),
keyed AS (SELECT match_id, coalesce(entry_type, '') || '|' || coalesce(matched_id, '') || '|' || coalesce(id_source, '') || '|' || array_to_string(list_sort(fields), '|') AS k FROM words),
reps AS (SELECT match_id, min(match_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS n_copies FROM keyed)
"""

SQL = {
    "p1_found": _KEYED + "SELECT keep_id, match_id AS copy_id FROM reps WHERE match_id <> keep_id",
    "p1_records": _KEYED + "SELECT keep_id, n_copies FROM reps WHERE match_id = keep_id",
}

QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_confidence": p5_confidence, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids, "p7_chunked_ids": p7_chunked_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_clamped_shares": p8_clamped_shares, "p9_found": p9_found, "p9_levels": p9_levels}
