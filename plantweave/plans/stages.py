"""Queries of single stages and expressions on the tables of the domain, each with its DuckDB equivalent."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import days, figures, text
from ..functions.geo import usable
from ..operators import decisions, entries, lookup, registry, spatial, volumes
from ..session import cut_lineage, shared_folder, table
from ..sources import delimited, sinks
from .catalogue import _CATEGORISED, _CONFIRMED, _HAV, _MAPPED, _NEAR, _comma, _confirmed, _mapped, _plain, _sum_sql, categorised

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# Cells and identifiers


@query("""SELECT cluster_id, CASE WHEN matched_id IS NULL THEN '' ELSE matched_id END AS mastr, CASE WHEN matched_id IS NULL THEN '' ELSE coalesce(location, '-') END AS opsd,
CASE WHEN method IN ('', 'nan') OR method IS NULL THEN '' ELSE method END AS eic FROM matches_cluster""")
def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lists of identifiers of a cell that holds a dictionary of lists, here made from the cluster's own columns."""
    cell = F.when(F.col("matched_id").isNotNull(), F.concat(F.lit("{'MASTR': ['MASTR-"), F.replace("matched_id", F.lit(","), F.lit("', 'MASTR-")), F.lit("'], 'OPSD': ['"), F.coalesce("location", F.lit("-")), F.lit("']}"))).otherwise("no dictionary")
    lists = text.id_lists(cell, F.col("method"))
    return table(spark, sf_dir, "matches_cluster").select("cluster_id", *[F.array_join(x, ",").alias(n) for x, n in zip(lists, ("mastr", "opsd", "eic"), strict=True)])


@query("""SELECT location, array_to_string(list_sort(list_distinct(flatten(list(string_split(matched_id, ',')) FILTER (matched_id IS NOT NULL)))), ',') AS ids, count(*) AS n FROM matches_cluster WHERE location IS NOT NULL GROUP BY location HAVING count(matched_id) > 0""")
def united_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members that the clusters of a place have, from their comma-separated cells."""
    rows = table(spark, sf_dir, "matches_cluster").filter("location IS NOT NULL").groupBy("location")
    return rows.agg(text.union_cells(F.col("matched_id")).alias("ids"), F.count(F.lit(1)).alias("n"), F.count("matched_id").alias("_m")).filter("_m > 0").drop("_m")


@query("""SELECT fueltype, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(match_names, ' | '))), lambda x: x <> ''))), ';') AS names FROM candidate_index WHERE match_names IS NOT NULL GROUP BY fueltype""")
def united_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all plants of a fuel, united from their arrays."""
    rows = table(spark, sf_dir, "candidate_index").filter("match_names IS NOT NULL").groupBy("fueltype")
    return rows.agg(F.array_join(text.union_sorted(F.split("match_names", r" \| ")), ";").alias("names"))


@query("""SELECT mastr_id, array_to_string(list_sort(list_distinct(list_filter([anzeigename, norm_name, ort], lambda x: x IS NOT NULL AND x <> '' AND x <> 'nan'))), ' | ') AS names FROM bnetza_lookup""")
def variant_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of a registry row in one cell."""
    return table(spark, sf_dir, "bnetza_lookup").select("mastr_id", registry.name_variants(F.col("anzeigename"), F.col("norm_name"), F.col("ort")).alias("names"))


@query("""WITH m AS (SELECT cluster_id, unnest(string_split(matched_id, ',')) AS id, generate_subscripts(string_split(matched_id, ','), 1) AS i FROM matches_cluster WHERE matched_id IS NOT NULL)
SELECT cluster_id, arg_min(name, i) AS name FROM m JOIN candidate_index USING (id) WHERE aliases IS NULL GROUP BY cluster_id""")
def first_listed_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cluster the name of the first listed member that has no alias."""
    rows = table(spark, sf_dir, "matches_cluster").filter("matched_id IS NOT NULL").select("cluster_id", F.split("matched_id", ",").alias("ids"))
    return registry.first_listed(rows, "cluster_id", "ids", table(spark, sf_dir, "candidate_index").filter("aliases IS NULL").select("id", "name"))


@query(f"""WITH u AS (SELECT *, split_part(name, ' ', 1) AS place FROM candidate_index WHERE fueltype IS NOT NULL),
c AS (SELECT place, fueltype, avg(lat) AS la, avg(lon) AS lo FROM u GROUP BY ALL), m AS (SELECT u.*, {_HAV.format('u.lat', 'u.lon', 'c.la', 'c.lo')} AS d FROM u JOIN c USING (place, fueltype)),
g AS (SELECT place, fueltype, count(*) AS n_units, coalesce(max(d), 0) AS span, min(id) AS id, array_to_string(list_sort(list_distinct(flatten(list(string_split(match_names, ' | '))))), ';') AS names, arg_min(technology, id) FILTER (technology <> '') AS technology FROM m GROUP BY ALL)
SELECT place, fueltype, id, n_units, names, technology FROM g WHERE n_units > 1 AND span <= 50
UNION ALL SELECT u.place, u.fueltype, u.id, 1, array_to_string(list_sort(list_distinct(string_split(u.match_names, ' | '))), ';'), nullif(u.technology, '') FROM u JOIN g USING (place, fueltype) WHERE g.n_units = 1 OR g.span > 50""")
def farm_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farms with the names of all their units and the technology of the first unit that tells one."""
    units = table(spark, sf_dir, "candidate_index").withColumn("place", F.split_part("name", F.lit(" "), F.lit(1))).withColumn("names", F.split("match_names", r" \| "))
    out = registry.farms(units, ["place", "fueltype"], "id", 50.0, lists=("names",), firsts=("technology",))
    return out.select("place", "fueltype", "id", "n_units", F.array_join("names", ";").alias("names"), "technology")


@query(f"""WITH idx AS (SELECT DISTINCT {_plain('v')} AS norm, id FROM (SELECT id, unnest(string_split(match_names, ' | ')) AS v FROM candidate_index)),
bn AS (SELECT DISTINCT {_plain('anzeigename')} AS norm, mastr_id AS candidate FROM bnetza_lookup WHERE anzeigename IS NOT NULL),
x AS (SELECT candidate, arg_min(id, (-capacity, id)) AS other FROM bn JOIN idx USING (norm) JOIN candidate_index USING (id) WHERE norm <> '' GROUP BY candidate)
SELECT DISTINCT norm, coalesce(other, candidate) AS candidate, CASE WHEN other IS NULL THEN 'bnetza' ELSE 'index' END AS id_source FROM bn LEFT JOIN x USING (candidate) WHERE norm <> ''""")
def bridged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry names told by the first plant of the index that has them, in an order of its own: the largest first."""
    index = table(spark, sf_dir, "candidate_index")
    idx = lookup.name_index(index, "id", F.split("match_names", r" \| "), "index").select("norm", F.col("candidate").alias("other"))
    placed = idx.join(index.select(F.col("id").alias("other"), F.struct(-F.col("capacity"), F.col("id")).alias("place")), "other")
    bn = lookup.name_index(table(spark, sf_dir, "bnetza_lookup"), "mastr_id", F.array("anzeigename"), "bnetza")
    return lookup.bridged(bn, bn.select("candidate", "norm").join(placed, "norm").select("candidate", "other", "place"))


# Texts

_FUEL_SQL = "CASE energietraeger WHEN 'Windenergie an Land' THEN 'Wind' WHEN 'Solare Strahlungsenergie' THEN 'Solar' WHEN 'Erdgas' THEN 'Natural Gas' WHEN 'Braunkohle' THEN 'Lignite' ELSE 'Other' END"


@query(f"SELECT mastr_id, {_FUEL_SQL} AS fuel FROM bnetza_lookup")
def fuel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuels in the words of the index; Other for all that the dictionary lacks."""
    words = {"Windenergie an Land": "Wind", "Solare Strahlungsenergie": "Solar", "Erdgas": "Natural Gas", "Braunkohle": "Lignite"}
    return table(spark, sf_dir, "bnetza_lookup").select("mastr_id", text.pick(F.col("energietraeger"), words, "Other").alias("fuel"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents""")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.html_escaped(F.col("text")).alias("html"))


@query("SELECT match_id, replace(url_encode(betroffene_anlage), '%2F', '/') AS path FROM matches_exact")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_exact").select("match_id", text.percent_encoded(F.col("betroffene_anlage")).alias("path"))


@query("""SELECT wiki_id, CASE WHEN trim(coalesce(confidence, '')) = '' THEN 'none' ELSE lower(trim(confidence)) END AS confidence, left(reasoning, 45) AS reason FROM (SELECT wiki_id, CASE WHEN wiki_id % 2 = 0 THEN '  ' || upper(confidence) || ' ' ELSE confidence END AS confidence, reasoning FROM matches_wikipedia)""")
def confidence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences as one of four words, however they are written, and the first 45 letters of the reason."""
    written = F.when(F.col("wiki_id") % 2 == 0, F.concat(F.lit("  "), F.upper("confidence"), F.lit(" "))).otherwise(F.col("confidence"))
    return table(spark, sf_dir, "matches_wikipedia").select("wiki_id", text.known_confidence(written).alias("confidence"), F.substring("reasoning", 1, 45).alias("reason"))


@query("""SELECT row_id, strftime(d, '%-d %b %Y') AS day, strftime(d, '%b %Y') AS month FROM (SELECT row_id, CAST(exported_at AS DATE) AS d FROM build_data)""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("exported_at")
    return table(spark, sf_dir, "build_data").select("row_id", days.day_label(d).alias("day"), days.month_label(d).alias("month"))


@query("SELECT betroffene_anlage, min(row_id) AS first FROM build_data WHERE betroffene_anlage IS NOT NULL GROUP BY betroffene_anlage")
def names_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct names of the log with the row where each comes up first."""
    return entries.first_seen(table(spark, sf_dir, "build_data"), "betroffene_anlage", "row_id")


# Decisions

@query(_NEAR + """, b AS (SELECT wiki_id, min(km) AS km FROM d GROUP BY 1), j AS (SELECT w.wiki_id, w.betroffene_anlage AS t, w.matched_id IS NOT NULL AS had, i.lat IS NOT NULL AS place, CASE WHEN b.km <= 5 THEN b.km END AS km FROM w LEFT JOIN candidate_index i ON w.matched_id = i.id LEFT JOIN b ON w.wiki_id = b.wiki_id)
SELECT wiki_id, CASE WHEN had AND place THEN CASE WHEN km <= 5 THEN 'chooser and ' || t || ' agree within ' || CAST(CAST(round(km) AS BIGINT) AS VARCHAR) || ' km' ELSE 'chooser and ' || t || ' disagree' END
  WHEN km <= 5 THEN 'nearest plant to ' || t || ' within ' || CAST(CAST(round(km) AS BIGINT) AS VARCHAR) || ' km' ELSE t || ' located, no plant within 5 km' END AS reason FROM j WHERE t IS NOT NULL""")
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outside location says of each plant, as a sentence."""
    wiki, index = table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "candidate_index")
    near = spatial.nearest_within(wiki, index, "wiki_id", "id", 5.0, inclusive=True).select(F.col("q_id").alias("wiki_id"), "km")
    located = wiki.filter(usable(F.col("lat"), F.col("lon")) & F.col("betroffene_anlage").isNotNull()).select("wiki_id", "betroffene_anlage", "matched_id")
    joined = located.join(index.select(F.col("id").alias("matched_id"), F.col("lat").alias("_lat")), "matched_id", "left").join(near, "wiki_id", "left")
    verdict = decisions.located_verdict(F.col("matched_id").isNotNull(), F.col("_lat").isNotNull(), F.col("km"))
    return joined.select("wiki_id", decisions.verdict_reason(verdict, F.col("betroffene_anlage"), F.col("km")).alias("reason"))


@query("""WITH m AS (SELECT betroffene_anlage, matched_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY betroffene_anlage ORDER BY wiki_id) AS rn FROM matches_wikipedia) WHERE rn = 1 AND betroffene_anlage IS NOT NULL)
SELECT match_id, e.betroffene_anlage, m.matched_id, m.confidence FROM matches_exact e LEFT JOIN m USING (betroffene_anlage)""")
def base_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the base with its match; as many rows come out as went in, or the query fails."""
    wiki = table(spark, sf_dir, "matches_wikipedia").filter("betroffene_anlage IS NOT NULL")
    matches = entries.first_by(wiki, ["betroffene_anlage"], "wiki_id", ["matched_id", "confidence"])
    return decisions.onto_base(table(spark, sf_dir, "matches_exact").select("match_id", "betroffene_anlage"), matches)


@query(f"""WITH {_CONFIRMED} SELECT d.wiki_id, CASE WHEN km IS NULL THEN 'no_geocode' WHEN km <= 30 THEN 'confirmed' ELSE 'disagree' END AS coord_check,
  CASE WHEN km > 30 AND coalesce(confidence, 'none') <> 'high' THEN coalesce(reasoning, '') || '; coordinates ' || CAST(CAST(round(round(km, 1)) AS BIGINT) AS VARCHAR) || ' km apart' ELSE reasoning END AS reasoning FROM d JOIN matches_wikipedia USING (wiki_id)""")
def confirmed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with the distance appended where coordinates disagree, unless the match is sure."""
    checked = _confirmed(spark, sf_dir)
    wiki = table(spark, sf_dir, "matches_wikipedia").select("wiki_id", "confidence", "reasoning")
    return checked.join(wiki, "wiki_id").select("wiki_id", "coord_check", decisions.reason_checked(F.col("reasoning"), F.col("confidence"), F.col("coord_check"), F.col("check_km")).alias("reasoning"))


# Volumes

_WINDOW = ("2022-01-01", "2022-06-30")


@query(f"""WITH {_MAPPED}, t AS (SELECT name, entry_type, confidence, day, round({_sum_sql('inc')}, 3) + round({_sum_sql('dec')}, 3) AS mwh FROM mapped WHERE name IS NOT NULL GROUP BY ALL),
s AS (SELECT name, coalesce(entry_type <> 'cluster' AND confidence IN ('high', 'medium'), FALSE) AS shown, {_sum_sql('mwh')} AS mwh FROM t WHERE day BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}' GROUP BY ALL)
SELECT name, round(mwh, 3) AS mwh, round(100 * mwh / nullif((SELECT {_sum_sql('mwh')} FROM s), 0), 4) AS pct, row_number() OVER (ORDER BY mwh DESC, name) AS place FROM s WHERE shown""")
def window_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants of high or medium confidence by their share of all volume in the window, that of hidden entries included."""
    rows = volumes.daily(_mapped(spark, sf_dir).filter("name IS NOT NULL"), "name", "entry_type", "confidence")
    shown = volumes.type_shown(F.col("entry_type"), F.col("confidence"), clusters=False, confidences=("high", "medium"))
    out = volumes.window_shares(rows, shown, *_WINDOW)
    return out.select("name", F.round("mwh", 3).alias("mwh"), F.round("pct", 4).alias("pct"), "place")


@query(f"""{_CATEGORISED}, g AS (SELECT category, round({_sum_sql('mwh')}, 3) AS mwh FROM cat GROUP BY 1), t AS (SELECT sum(mwh) AS t FROM g) SELECT category, CASE WHEN t > 0 THEN printf('%.1f%%', 100 * mwh / t) ELSE '—' END AS share FROM g, t""")
def share_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the categories as they are written."""
    g = categorised(spark, sf_dir).groupBy("category").agg(F.round(volumes.exact_sum("mwh"), 3).alias("mwh"))
    g = cut_lineage(g)
    return g.crossJoin(F.broadcast(g.agg(F.sum("mwh").alias("t")))).select("category", figures.share_label(F.col("mwh"), F.col("t")).alias("share"))  # with one row


# Sources and sinks: written to the shared folder and read back

def _new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_LINE = "regexp_replace({0}, '[\\r\\n]+', ' ', 'g')"


def _one_line(df: DataFrame) -> DataFrame:
    """Exports hold one row a line."""
    return df.select(*[F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


@query("SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"nullif({_LINE.format(c)}, '') AS {c}" for c in ("betroffene_anlage", "richtung", "gesamte_arbeit_mwh")) + " FROM build_data")
def export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports with other column orders and blanks in their header names, read as one table of text."""
    calls = _one_line(table(spark, sf_dir, "build_data").select("row_id", "betroffene_anlage", "richtung", "gesamte_arbeit_mwh"))
    paths = [_new_path(spark), _new_path(spark)]
    first = calls.filter("row_id % 2 = 0").toDF(" ROW_ID", "BETROFFENE_ANLAGE ", " RICHTUNG ", "GESAMTE_ARBEIT_MWH")
    second = calls.filter("row_id % 2 = 1").select("richtung", "gesamte_arbeit_mwh", "row_id", "betroffene_anlage")
    for df, path in zip((first, second), paths, strict=True):
        sinks.write_delimited(df, path, sep=";")
    out = delimited.read_export(spark, *paths)
    return out.select("row_id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("betroffene_anlage", "richtung", "gesamte_arbeit_mwh")])


@query("SELECT CAST(match_id AS VARCHAR) AS match_id, nullif(replace(replace(betroffene_anlage, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS betroffene_anlage, matched_id FROM matches_exact")
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table written with commas and read back, whatever its names hold."""
    path = _new_path(spark)
    sinks.write_delimited(table(spark, sf_dir, "matches_exact").select("match_id", "betroffene_anlage", "matched_id"), path)
    back = delimited.read_plain(spark, path)
    lines = F.replace(F.replace("betroffene_anlage", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return back.select("match_id", F.nullif(lines, F.lit("")).alias("betroffene_anlage"), "matched_id")


_LATIN = "regexp_replace({0}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


@query(f"""SELECT mastr_id, {_LATIN.format('anzeigename')} AS anzeigename, energietraeger, round(nettonennleistung_mw, 3) AS nettonennleistung_mw, {_LATIN.format('ort')} AS ort FROM bnetza_lookup WHERE anzeigename IS NOT NULL AND ort IS NOT NULL""")
def legacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a file in an old encoding with nine lines before its header, read and reduced to the lookup."""
    rows = _one_line(table(spark, sf_dir, "bnetza_lookup").filter("anzeigename IS NOT NULL AND ort IS NOT NULL"))
    net = F.replace(F.col("nettonennleistung_mw").cast("string"), F.lit("."), F.lit(","))
    cells = F.struct(F.when(F.col("mastr_id").endswith("5"), "stillgelegte Anlagen").otherwise("Einzelanlage").alias("Datensatztyp*"), F.col("mastr_id").alias("EinheitMastrNummer"), "anzeigename", "energietraeger", net.alias("net"), "postleitzahl", "ort")
    lines = rows.select(F.lit(2).alias("i"), F.to_csv(cells, {"sep": ";", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))
    head = ["Marktstammdaten"] * 4 + ["Stand: heute"] * 5
    above = spark.createDataFrame([(0, x) for x in head] + [(1, "Datensatztyp*;EinheitMastrNummer;Anzeigename;Energietraeger;Nettonennleistung_MW;Postleitzahl;Ort")], "i int, line string")
    dropped = spark.createDataFrame([(2, "Summe;X;Y;Z;0;0;0")], "i int, line string")
    path = _new_path(spark)
    # One file, as the source is; its head stands first.
    ordered = above.unionByName(lines).unionByName(dropped).repartition(1).sortWithinPartitions("i").select("line")
    ordered.write.csv(path, sep="\x01", quote="\x00", encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = delimited.registry_lookup(delimited.read_after_lines(spark, path))
    return out.select("mastr_id", "anzeigename", "energietraeger", F.round("nettonennleistung_mw", 3).alias("nettonennleistung_mw"), "ort")


@query("""SELECT CAST(match_id AS BIGINT) AS match_id, method FROM matches_exact WHERE match_id % 3 <> 0""")
def resumed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that two overlapping batches are appended to, then rewritten in place without a third of its rows."""
    rows = table(spark, sf_dir, "matches_exact").select("match_id", "method")
    path = _new_path(spark)
    sinks.append_new(rows.filter("match_id % 2 = 0"), path, "match_id")
    sinks.append_new(rows, path, "match_id")
    sinks.replace_table(spark.read.parquet(path).filter("match_id % 3 <> 0"), path)
    return spark.read.parquet(path)


@query("""SELECT 'absent' AS kind, count(*) AS n FROM matches_exact WHERE FALSE UNION ALL SELECT 'limited', least(count(*), 7) FROM matches_exact UNION ALL SELECT 'whole', count(*) FROM matches_exact""")
def optional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that isn't there is empty; a smoke run sees the first rows, which is the feature; without a limit it sees all."""
    exact = table(spark, sf_dir, "matches_exact")
    absent = delimited.read_or_empty(spark, f"{sf_dir}/no_such_table.parquet", "match_id long")
    counts = [df.select("match_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in (("absent", absent), ("limited", delimited.sample_run(exact, 7)), ("whole", delimited.sample_run(exact, None)))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT count(*) AS n_plants, count(DISTINCT name) AS n_names FROM (SELECT DISTINCT name FROM candidate_index WHERE lat IS NOT NULL)")
def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of the map with one plant a name; what it holds is read back from its text."""
    plants = table(spark, sf_dir, "candidate_index").filter("lat IS NOT NULL").groupBy("name").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("fueltype").alias("fueltype"))
    shown = plants.select("name", "lat", "lon", "fueltype", F.lit("individual").alias("entry_type"), F.lit(True).alias("matched"), F.lit(" HIGH ").alias("confidence"), F.create_map(F.lit("2024-01-01"), F.array(F.lit(1.0), F.lit(0.0))).alias("series"))
    none = spark.createDataFrame([], "category string, day string, mwh double")
    doc = sinks.map_document(shown, none, plants.agg(F.count(F.lit(1)).alias("n_plants")))
    told = json.loads(doc.removeprefix("const MAP_DATA = ").rstrip(";\n"))
    names = {p["name"] for p in told["plants"] if p["confidence"] == "high"}
    return spark.createDataFrame([(told["meta"]["n_plants"], len(names))], "n_plants long, n_names long")
