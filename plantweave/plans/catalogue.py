"""The queries of the general operators on the tables of the domain, each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import figures, text
from ..functions.days import clock_change, local_day, written_moment
from ..operators import components, decisions, edits, entries, lookup, registry, shortlist, spatial, volumes
from ..session import cut_lineage, maybe_broadcast, shared_folder, table
from ..sources import resolvers
from ..streaming import daily as stream
from . import pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# SQL pieces that several queries share. DuckDB's patterns have no look-around, and \w is ASCII there.
_SPACE = r"\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _plain(x: str, any_case: bool = True, underscores: bool = True) -> str:
    s = f"regexp_replace({_strip(x)}, '{'(?i)' if any_case else ''}^\\s*({text.GRID_PREFIXES})\\s+', '')"
    if underscores:
        s = f"replace({s}, '_', ' ')"
    s = f"regexp_replace({s}, '\\([^)]*\\)', ' ', 'g')"
    s = rf"regexp_replace({s}, '[^\pL\pM\p{{Nd}}\p{{Pc}}\x{{200C}}\x{{200D}}{_SPACE}-]', ' ', 'g')"
    return f"lower({_strip(f'''regexp_replace({s}, '[{_SPACE}]+', ' ', 'g')''')})"


def _rules(x: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{label}'" for label, cond in rules) + f" ELSE {otherwise} END"


def _parts(x: str) -> str:
    return f"list_transform(string_split({x}, ','), lambda p: {_strip('p')})"


def _several(x: str) -> str:
    return f"len(list_filter({_parts(x)}, lambda p: regexp_matches(p, '[A-Za-zÄÖÜäöüß]{{4,}}'))) >= 2"


def _comma(x: str) -> str:
    return f"try_cast(replace({_strip(x)}, ',', '.') AS DOUBLE)"


def _sum_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(24, 6))) AS DOUBLE)"


_ENTRY_TYPE = _rules(
    "n",
    [
        ("countertrade", r"regexp_matches(n, '(?i)^\s*Börse')"), ("emergency", "regexp_matches(n, '(?i)Notfall')"),
        ("foreign", "regexp_matches(n, '(?i)Vianden|K[üu]htai|illwerke|Vorarlberger|Ilwerke')"),
        ("cluster", r"regexp_matches(n, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])Cluster($|[^\pL\pM\p{Nd}\p{Pc}])')"),
        ("control_reserve", r"regexp_matches(n, '(?i)_CR_|_CR($|[^\pL\pM\p{Nd}\p{Pc}])')"),
        ("substation", r"regexp_matches(n, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])UW($|[^\pL\pM\p{Nd}\p{Pc}])|Umspannwerk')"),
        ("regional_renewable", r"regexp_matches(n, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])EE($|[^\pL\pM\p{Nd}\p{Pc}])')"),
    ],
    "CASE WHEN " + _several("n") + " THEN 'multi_plant' ELSE 'individual' END",
)
_HAV = "2 * 6371.0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"
_DAY = r"""
strptime_ok AS (SELECT *, CASE WHEN regexp_full_match(beginn_datum, '\d{2}\.\d{2}\.\d{4}') AND regexp_full_match(beginn_uhrzeit, '\d{2}:\d{2}')
  THEN try_strptime(beginn_datum || ' ' || beginn_uhrzeit, '%d.%m.%Y %H:%M') END AS wall FROM build_data),
clocked AS (SELECT *, upper(""" + _strip("coalesce(zeitzone_von, '')") + r""") = 'UTC' AS is_utc,
  (((wall AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC') AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS back,
  (wall AT TIME ZONE 'Europe/Berlin') AS inst FROM strptime_ok),
judged AS (SELECT *, CASE WHEN back <> wall THEN 'skipped' WHEN (inst + INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Berlin' = wall OR (inst - INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Berlin' = wall THEN 'repeated' END AS change FROM clocked),
dayed AS (SELECT *, CAST(CASE WHEN is_utc THEN (wall AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' WHEN change IS NULL THEN wall END AS DATE) AS day FROM judged)"""
_VOLUMES = _DAY + f""",
numbered AS (SELECT nullif(nullif({_strip('betroffene_anlage')}, ''), 'nan') AS name, day, CASE WHEN regexp_full_match(beginn_datum, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN year(try_strptime(beginn_datum, '%d.%m.%Y')) END AS year,
  abs({_comma('gesamte_arbeit_mwh')}) AS mwh, lower(coalesce(richtung, '')) AS d FROM dayed),
volumes AS (SELECT name, day, year, mwh, CASE WHEN contains(d, 'erh') THEN mwh ELSE 0.0 END AS inc, CASE WHEN contains(d, 'reduzieren') THEN mwh ELSE 0.0 END AS dec FROM numbered WHERE day IS NOT NULL AND mwh IS NOT NULL AND NOT isnan(mwh))"""
#: The resolved entries that the volume queries join: one row a name.
_RESOLVED = """
resolved AS (SELECT name, entry_type, confidence, matched_id, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio DESC, id) AS rn FROM (
    SELECT trim(betroffene_anlage) AS name, entry_type, CASE WHEN matched_id IS NULL THEN 'none' ELSE 'high' END AS confidence, matched_id, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, 0 AS prio, match_id AS id FROM matches_exact
    UNION ALL SELECT trim(betroffene_anlage), 'cluster', coalesce(confidence, 'none'), matched_id, lat, lon, 1, cluster_id FROM matches_cluster
    UNION ALL SELECT trim(betroffene_anlage), 'individual', coalesce(confidence, 'none'), matched_id, lat, lon, 2, wiki_id FROM matches_wikipedia) WHERE name IS NOT NULL) WHERE rn = 1)"""
_CATEGORY = """CASE WHEN r.name IS NULL THEN 'out of scope' WHEN r.matched_id IS NOT NULL THEN 'matched ' || r.confidence
  WHEN r.entry_type IN ('control_reserve', 'substation', 'regional_renewable', 'countertrade', 'emergency', 'foreign') THEN 'aggregate' ELSE 'unmatched' END"""
_CATEGORISED = f"WITH {_VOLUMES}, {_RESOLVED}, cat AS (SELECT v.*, {_CATEGORY} AS category FROM volumes v LEFT JOIN resolved r ON v.name = r.name)"
_CATS = ["matched high", "matched medium", "matched low", "unmatched", "aggregate", "out of scope"]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a name from the exact, cluster and residual matches, later stages first, of a stage's rows the first."""
    columns = ["entry_type", "confidence", "matched_id", "lat", "lon"]
    named = lambda t: table(spark, sf_dir, t).withColumn("name", F.trim("betroffene_anlage")).filter("name IS NOT NULL")
    none = F.lit(None).cast("double")
    exact = named("matches_exact").withColumn("confidence", F.when(F.col("matched_id").isNull(), "none").otherwise("high")).withColumn("lat", none).withColumn("lon", none)
    level = F.coalesce("confidence", F.lit("none"))
    cluster = named("matches_cluster").withColumn("entry_type", F.lit("cluster")).withColumn("confidence", level)
    wiki = named("matches_wikipedia").withColumn("entry_type", F.lit("individual")).withColumn("confidence", level)
    stages = [entries.first_by(df, ["name"], order, columns) for df, order in ((exact, "match_id"), (cluster, "cluster_id"), (wiki, "wiki_id"))]
    return decisions.merged(stages, "name", columns)


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = volumes.volumes(table(spark, sf_dir, "build_data"))
    r = maybe_broadcast(resolved(spark, sf_dir).withColumn("_known", F.lit(True)))
    known = F.coalesce("_known", F.lit(False))
    return calls.join(r, "name", "left").withColumn("category", volumes.match_category(known, F.col("matched_id").isNotNull(), F.col("confidence"), F.col("entry_type")))


# Names

@query(f"SELECT match_id, {_plain('betroffene_anlage')} AS norm FROM matches_exact")
def norm_light_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_exact").select("match_id", text.plain_name(F.col("betroffene_anlage")).alias("norm"))


@query(f"SELECT mastr_id, {_plain('anzeigename', False, False)} AS norm FROM bnetza_lookup")
def norm_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bnetza_lookup").select("mastr_id", text.plain_name(F.col("anzeigename"), any_case=False, underscores=False).alias("norm"))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_PLACE_STOPS = ", ".join(f"'{w}'" for w in text.PLACE_STOP_WORDS)


@query(f"""WITH p AS (SELECT match_id, {_plain('betroffene_anlage')} AS n FROM matches_exact),
h AS (SELECT match_id, n, array_to_string(list_filter(string_split(n, ' '), lambda w: w NOT IN ({_STOPS}) AND NOT regexp_full_match(w, 't[0-9]+')), ' ') AS h FROM p)
SELECT match_id, CASE WHEN h = '' THEN n ELSE h END AS core FROM h""")
def norm_heavy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_exact").select("match_id", text.core_name(F.col("betroffene_anlage")).alias("core"))


@query(f"""SELECT cluster_id, array_to_string(list_filter(string_split_regex(replace({_plain('betroffene_anlage')}, '-', ' '), '\\s+'),
  lambda w: w NOT IN ({_PLACE_STOPS}) AND NOT regexp_full_match(w, '[0-9]+|t[0-9]+') AND length(w) >= 4), ' ') AS place FROM matches_cluster""")
def location_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_cluster").select("cluster_id", F.array_join(text.place_words(F.col("betroffene_anlage")), " ").alias("place"))


@query(f"SELECT match_id, {_ENTRY_TYPE} AS entry_type FROM (SELECT match_id, betroffene_anlage AS n FROM matches_exact WHERE betroffene_anlage IS NOT NULL)")
def rule_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_exact").filter("betroffene_anlage IS NOT NULL").select("match_id", text.entry_type(F.col("betroffene_anlage")).alias("entry_type"))


@query(r"""SELECT doc_id, CASE
 WHEN regexp_matches(text, '(?i)(^|[^A-Za-zÄÖÜäöüß])WIND($|[^A-Za-zÄÖÜäöüß])') THEN 'Wind'
 WHEN regexp_matches(text, '(?i)PHOTOVOLTAIK|(^|[^A-Za-zÄÖÜäöüß])PV($|[^A-Za-zÄÖÜäöüß])') THEN 'Solar'
 WHEN regexp_matches(text, '(?i)SONSTIGE_EE') THEN 'Other renewable' WHEN regexp_matches(text, '(?i)KONVENTIONELL') THEN 'Conventional'
 WHEN regexp_matches(text, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])OWP($|[^\pL\pM\p{Nd}\p{Pc}])') THEN 'Wind'
 WHEN regexp_matches(text, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])UW($|[^\pL\pM\p{Nd}\p{Pc}])|Umspannwerk') AND regexp_matches(text, '(?i)büttel|buettel|diele|dörpen|dorpen|emden|garrel|baltic') THEN 'Wind'
 ELSE '' END AS technology FROM documents WHERE text IS NOT NULL""")
def name_technology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.told_technology(F.col("text")).alias("technology"))


@query(f"""WITH x AS (SELECT match_id, betroffene_anlage AS n FROM matches_exact WHERE betroffene_anlage IS NOT NULL),
p AS (SELECT match_id, unnest(CASE WHEN {_several('n')} THEN {_parts('n')} ELSE [] END) AS part, generate_subscripts(CASE WHEN {_several('n')} THEN {_parts('n')} ELSE [] END, 1) - 1 AS i FROM x)
SELECT match_id, CAST(i AS INTEGER) AS i, part FROM p""")
def multi_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches_exact").select("match_id", F.posexplode(text.listed_parts(F.col("betroffene_anlage"))).alias("i", "part"))


@query(f"SELECT row_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS mw, CASE WHEN isnan(y) THEN NULL ELSE abs(y) END AS mwh FROM (SELECT row_id, {_comma('maximale_leistung_mw')} AS x, {_comma('gesamte_arbeit_mwh')} AS y FROM build_data)")
def comma_decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "build_data").select("row_id", text.decimal_comma(F.col("maximale_leistung_mw")).alias("mw"), F.abs(text.decimal_comma(F.col("gesamte_arbeit_mwh"))).alias("mwh"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_ids_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell that holds a dictionary, read as a map."""
    read = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(read, F.lit("k")).alias("k"))


# Entries

@query(f"""WITH x AS (SELECT nullif(nullif({_strip('betroffene_anlage')}, ''), 'nan') AS n, nullif(nullif({_strip('primaerenergieart')}, ''), 'nan') AS e, {_comma('maximale_leistung_mw')} AS p0, nullif(nullif({_strip('anweisender_uenb')}, ''), 'nan') AS o FROM build_data),
y AS (SELECT n, e, CASE WHEN isnan(p0) THEN NULL ELSE p0 END AS p, o FROM x WHERE n IS NOT NULL),
g AS (SELECT n, count(DISTINCT e) > 1 AS energy_conflict, max(p) AS max_dispatched_mw, coalesce(array_to_string(list_sort(list(DISTINCT o) FILTER (o IS NOT NULL)), ','), '') AS tsos, count(*) AS n_events FROM y GROUP BY n),
m AS (SELECT n, e FROM (SELECT n, e, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, e) AS rn FROM y WHERE e IS NOT NULL GROUP BY n, e) WHERE rn = 1)
SELECT g.n AS betroffene_anlage, coalesce(m.e, '') AS primaerenergieart, energy_conflict, max_dispatched_mw, tsos, n_events, {_ENTRY_TYPE.replace('(n,', '(g.n,').replace('string_split(n', 'string_split(g.n')} AS entry_type FROM g LEFT JOIN m ON g.n = m.n""")
def key_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.entries(table(spark, sf_dir, "build_data")).drop("name_technology")


@query("SELECT method AS value, count(*) AS n FROM matches_exact GROUP BY method")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.value_counts(table(spark, sf_dir, "matches_exact"), "method")


_ROW = "betroffene_anlage, primaerenergieart, anweisender_uenb, maximale_leistung_mw, gesamte_arbeit_mwh, richtung, beginn_datum, beginn_uhrzeit, zeitzone_von"


@query(f"""SELECT source, count(*) AS n_rows FROM (
  SELECT DISTINCT 'old' AS source, {_ROW} FROM build_data WHERE exported_at < TIMESTAMP '2021-01-01'
  UNION ALL SELECT DISTINCT 'new' AS source, {_ROW} FROM build_data WHERE exported_at >= TIMESTAMP '2021-01-01') GROUP BY source""")
def dedupe_then_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "build_data")
    cut = F.lit("2021-01-01").cast("timestamp")
    row = _ROW.split(", ")
    old = calls.filter(F.col("exported_at") < cut).select(*row, F.lit("old").alias("source"))
    new = calls.filter(F.col("exported_at") >= cut).select(*row, F.lit("new").alias("source"))
    return entries.united(old, new).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH n AS (SELECT DISTINCT {_strip('betroffene_anlage')} AS part FROM matches_exact),
p AS (SELECT DISTINCT unnest({_parts('betroffene_anlage')}) AS part FROM matches_exact WHERE {_several('betroffene_anlage')})
SELECT count(*) AS n_parts, count(*) FILTER (n.part IS NULL) AS n_missing FROM p LEFT JOIN n ON p.part = n.part""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.parts_without_entry(table(spark, sf_dir, "matches_exact"))


# Lookups

_INDEX = f"""idx AS (SELECT DISTINCT {_plain('v')} AS norm, id AS candidate, 'index' AS id_source FROM (SELECT id, unnest(string_split(match_names, ' | ')) AS v FROM candidate_index)),
bn AS (SELECT DISTINCT {_plain('anzeigename')} AS norm, mastr_id AS candidate, 'bnetza' AS id_source FROM bnetza_lookup),
both_ AS (SELECT * FROM idx UNION SELECT * FROM bn),
forms AS (SELECT norm, count(DISTINCT (candidate, id_source)) AS n_candidates, min(candidate) AS c, min(id_source) AS s FROM both_ WHERE norm IS NOT NULL AND norm <> '' GROUP BY norm)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lookup.name_index(table(spark, sf_dir, "candidate_index"), "id", F.split("match_names", r" \| "), "index")
    return names.unionByName(lookup.name_index(table(spark, sf_dir, "bnetza_lookup"), "mastr_id", F.array("anzeigename"), "bnetza"))


@query(f"""WITH {_INDEX}, q AS (SELECT DISTINCT betroffene_anlage, {_plain('betroffene_anlage')} AS norm FROM matches_exact)
SELECT betroffene_anlage, CASE WHEN n_candidates = 1 THEN c END AS candidate, CASE WHEN n_candidates = 1 THEN s END AS id_source, n_candidates FROM q JOIN forms USING (norm)""")
def inverted_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in the plant index or the registry; null candidates where several are found."""
    return lookup.unique_hits(table(spark, sf_dir, "matches_exact").select("betroffene_anlage").distinct(), _index(spark, sf_dir))


@query(f"""WITH {_INDEX} SELECT norm, c AS candidate, s AS id_source FROM forms WHERE n_candidates = 1""")
def unique_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms that exactly one identifier has."""
    index = _index(spark, sf_dir)
    hits = index.groupBy("norm").agg(F.count_distinct("candidate", "id_source").alias("n"), F.min("candidate").alias("candidate"), F.min("id_source").alias("id_source"))
    return hits.filter("n = 1").drop("n")


@query("""SELECT DISTINCT betroffene_anlage FROM matches_cluster_pending p WHERE betroffene_anlage IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM matches_cluster c WHERE c.betroffene_anlage = p.betroffene_anlage) AND NOT EXISTS (SELECT 1 FROM matches_exact e WHERE e.betroffene_anlage = p.betroffene_anlage)""")
def anti_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "matches_cluster_pending").select("betroffene_anlage").filter("betroffene_anlage IS NOT NULL").distinct()
    return lookup.open_entries(pending, table(spark, sf_dir, "matches_cluster"), table(spark, sf_dir, "matches_exact"))


_FIT_SQL = """(CASE e.energy WHEN 'Konventionell' THEN c.fueltype IN ('Natural Gas', 'Hard Coal', 'Lignite', 'Oil', 'Waste', 'Other')
  WHEN 'Erneuerbar' THEN c.fueltype IN ('Solar', 'Wind', 'Hydro', 'Biogas', 'Solid Biomass', 'Geothermal') ELSE TRUE END)
  AND (e.mw IS NULL OR coalesce(c.capacity, 0) = 0 OR c.capacity >= e.mw * 0.7)"""
_FITTING_SQL = f"""e AS (SELECT {_plain('betroffene_anlage')} AS norm, min(primaerenergieart) AS energy, max(max_dispatched_mw) AS mw FROM matches_exact WHERE entry_type = 'individual' AND betroffene_anlage IS NOT NULL GROUP BY 1),
v AS (SELECT DISTINCT id, fueltype, capacity, {_plain('n')} AS cand FROM (SELECT id, fueltype, capacity, unnest(string_split(match_names, ' | ')) AS n FROM candidate_index WHERE entry_type = 'individual')),
c AS (SELECT * FROM v WHERE length(cand) >= 4)"""
_ASCII = r"regexp_replace(translate({0}, 'äöüß', 'aous'), '[^\x00-\x7F]', '?', 'g')"
_LEV_SQL = f"""{_FITTING_SQL},
s AS (SELECT e.norm, c.id, c.cand, round(1 - levenshtein({_ASCII.format('e.norm')}, {_ASCII.format('c.cand')}) / CAST(greatest(length(e.norm), length(c.cand)) AS DOUBLE), 6) AS score FROM e JOIN c ON {_FIT_SQL}),
n200 AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, cand, id) AS seen FROM s QUALIFY seen <= 200),
b AS (SELECT norm, id, max(score) AS score, min(seen) AS seen FROM n200 GROUP BY norm, id),
r AS (SELECT norm, id, score, row_number() OVER (PARTITION BY norm ORDER BY score DESC, seen) AS rank FROM b QUALIFY rank <= 20)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = table(spark, sf_dir, "matches_exact").filter("entry_type = 'individual' AND betroffene_anlage IS NOT NULL")
    return exact.select(text.plain_name(F.col("betroffene_anlage")).alias("query"), "primaerenergieart", "max_dispatched_mw").groupBy("query").agg(F.min("primaerenergieart").alias("energy"), F.max("max_dispatched_mw").alias("mw"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of every plant: id, variant, fueltype, capacity."""
    plants = table(spark, sf_dir, "candidate_index").filter("entry_type = 'individual'").select("id", "fueltype", "capacity", F.explode(F.split("match_names", r" \| ")).alias("_n"))
    return plants.select("id", text.plain_name(F.col("_n")).alias("variant"), "fueltype", "capacity").filter(F.length("variant") >= 4).distinct()


def _nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm, id, score, rank): the twenty plants of the most similar names by edits, of all that fit in fuel and size."""
    return edits.fewest_edits(_asked(spark, sf_dir), _variants(spark, sf_dir), 20).withColumnRenamed("query", "norm")


@query(f"WITH {_FITTING_SQL}, f AS (SELECT id, fueltype, capacity FROM c GROUP BY ALL) SELECT norm, count(c.id) AS n_fit FROM e LEFT JOIN f c ON {_FIT_SQL} GROUP BY norm")
def prefilter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many plants fit each entry in fuel and size. Plants are counted by fuel and size first, so no pair of an entry and a plant is a row."""
    sizes = _variants(spark, sf_dir).select("id", "fueltype", "capacity").distinct().groupBy("fueltype", "capacity").agg(F.count(F.lit(1)).alias("n"))
    by_fuel = sizes.groupBy("fueltype").agg(F.collect_list(F.struct(F.coalesce("capacity", F.lit(0.0)).alias("capacity"), "n")).alias("_sizes"))
    all_fuels = by_fuel.agg(F.collect_list(F.struct("fueltype", "_sizes")).alias("_all"))  # one row: sizes are few beside plants
    room = lambda s: F.when(lookup.fits_power(F.col("mw"), s["capacity"]), s["n"]).otherwise(0)
    fits = lambda f: F.when(lookup.fits_fuel(F.col("energy"), f["fueltype"]), F.aggregate(f["_sizes"], F.lit(0).cast("long"), lambda a, s: a + room(s))).otherwise(0)
    asked = _asked(spark, sf_dir).crossJoin(maybe_broadcast(all_fuels))  # with one row
    return asked.select(F.col("query").alias("norm"), F.aggregate("_all", F.lit(0).cast("long"), lambda a, f: a + fits(f)).alias("n_fit"))


@query(f"WITH {_LEV_SQL} SELECT norm, id, score, CAST(rank AS INTEGER) AS rank FROM r")
def fuzzy_topk_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty plants most like each name by edits, of the two hundred best of all names of all plants that fit."""
    return _nearest_names(spark, sf_dir)


def _shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm, id, score, rank): the twenty plants most like each entry name, of all that fit in fuel and size."""
    exact = table(spark, sf_dir, "matches_exact").filter("entry_type = 'individual' AND betroffene_anlage IS NOT NULL")
    name = F.col("betroffene_anlage")
    asked = shortlist.core_queries(exact, text.plain_name(name), name, F.col("primaerenergieart"), F.col("max_dispatched_mw"))
    return shortlist.most_similar(asked, table(spark, sf_dir, "candidate_index").filter("entry_type = 'individual'"), 20).withColumnRenamed("entry", "norm")


@query()
def fuzzy_topk_wratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty plants most like each name by the weighted similarity; SQL has no such function."""
    return _shortlist(spark, sf_dir).withColumn("score", F.round("score", 1))


@query(f"""WITH {_LEV_SQL}, picks AS (SELECT norm, CASE WHEN length(norm) % 3 = 0 THEN '999' ELSE min(id) END AS id FROM r GROUP BY norm)
SELECT p.norm, CASE WHEN s.id IS NOT NULL THEN p.id END AS id, s.id IS NULL AS rejected FROM picks p LEFT JOIN r s ON p.norm = s.norm AND p.id = s.id""")
def hallucination_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks of a chooser, a third of them invented, held against each entry's shortlist."""
    listed = cut_lineage(_nearest_names(spark, sf_dir))
    picks = listed.groupBy("norm").agg(F.min("id").alias("id")).withColumn("id", F.when(F.length("norm") % 3 == 0, "999").otherwise(F.col("id")))
    return lookup.guarded(picks, listed, "norm", "id")


# Registry

@query(f"""WITH u AS (SELECT *, split_part(name, ' ', 1) AS place FROM candidate_index WHERE fueltype IS NOT NULL AND technology IS NOT NULL),
c AS (SELECT place, fueltype, technology, avg(lat) AS la, avg(lon) AS lo FROM u GROUP BY ALL),
m AS (SELECT u.*, {_HAV.format('u.lat', 'u.lon', 'c.la', 'c.lo')} AS d FROM u JOIN c USING (place, fueltype, technology)),
g AS (SELECT place, fueltype, technology, count(*) AS n_units, coalesce(max(d), 0) AS span, min(id) AS id, sum(capacity) AS capacity, avg(lat) AS lat, avg(lon) AS lon, array_to_string(list_sort(list(id)), ',') AS source_ids FROM m GROUP BY ALL),
o AS (SELECT place, fueltype, technology, id, capacity, lat, lon, n_units, source_ids FROM g WHERE n_units > 1 AND span <= 2
  UNION ALL SELECT u.place, u.fueltype, u.technology, u.id, u.capacity, u.lat, u.lon, 1, u.id FROM u JOIN g USING (place, fueltype, technology) WHERE g.n_units = 1 OR g.span > 2)
SELECT place, fueltype, technology, id, round(capacity, 4) AS capacity, round(lat, 4) AS lat, round(lon, 4) AS lon, n_units, source_ids FROM o""")
def farm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants of one place, fuel and technology merged if they lie within 2 km."""
    units = table(spark, sf_dir, "candidate_index").withColumn("place", F.split_part("name", F.lit(" "), F.lit(1)))
    out = registry.farms(units, ["place", "fueltype", "technology"], "id", 2.0)
    return out.select("place", "fueltype", "technology", "id", *[F.round(c, 4).alias(c) for c in ("capacity", "lat", "lon")], "n_units", "source_ids")


@query("""WITH f AS (SELECT *, coalesce(technology, '') AS tech FROM candidate_index WHERE capacity >= 1 AND lat IS NOT NULL AND lon IS NOT NULL AND fueltype IN ('Wind', 'Solar', 'Biogas')),
n AS (SELECT fueltype, tech FROM f GROUP BY ALL HAVING count(*) >= 3) SELECT id, fueltype, tech AS technology FROM f JOIN n USING (fueltype, tech)""")
def cluster_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.eligible(table(spark, sf_dir, "candidate_index")).select("id", "fueltype", "technology")


# Space

_IDX = "i AS (SELECT id, lat, lon, fueltype FROM candidate_index WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0))"
_GRID = f"""{_IDX}, g AS (SELECT a.id AS id_a, b.id AS id_b, {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM i a JOIN i b ON a.id < b.id
  AND abs(trunc(a.lat / CAST(0.1 AS DOUBLE)) - trunc(b.lat / CAST(0.1 AS DOUBLE))) <= 1 AND abs(trunc(a.lon / CAST(0.1 AS DOUBLE)) - trunc(b.lon / CAST(0.1 AS DOUBLE))) <= 1), e AS (SELECT * FROM g WHERE km <= 10)"""


@query(f"WITH {_GRID} SELECT id_a, id_b, round(km, 4) AS km FROM e")
def grid_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grid_pairs(table(spark, sf_dir, "candidate_index"), "id", 10.0).withColumn("km", F.round("km", 4))


@query(f"""WITH RECURSIVE {_GRID}, s AS (SELECT id_a AS a, id_b AS b FROM e UNION SELECT id_b, id_a FROM e),
r AS (SELECT DISTINCT a AS id, a AS reach FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.reach = s.a)
SELECT i.id, coalesce(min(reach), i.id) AS component FROM i LEFT JOIN r ON i.id = r.id GROUP BY i.id""")
def geo_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of plants that steps of at most 10 km connect."""
    points = table(spark, sf_dir, "candidate_index").filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    found = components.components(spatial.grid_pairs(points, "id", 10.0))
    return components.with_singles(points, found, "id")


def _split_sql(source: str, same: str = "TRUE") -> str:
    """Three rounds of joining by 10, 5 and 2.5 km, each over what was too wide before, by every (n div 50)-th point."""
    ctes, part = [f"p0 AS (SELECT *, '' AS part FROM ({source}))"], "p0"
    for k, km in enumerate((10, 5, 2.5), 1):
        near = f"abs(trunc(a.lat / CAST(0.1 AS DOUBLE)) - trunc(b.lat / CAST(0.1 AS DOUBLE))) <= 1 AND abs(trunc(a.lon / CAST(0.1 AS DOUBLE)) - trunc(b.lon / CAST(0.1 AS DOUBLE))) <= 1"
        ctes += [
            f"e{k} AS (SELECT a.id AS a, b.id AS b FROM {part} a JOIN {part} b ON a.id <> b.id AND a.part = b.part AND {same} AND {near} AND {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {km})",
            f"r{k} AS (SELECT DISTINCT a AS id, a AS reach FROM e{k} UNION SELECT r{k}.id, e{k}.b FROM r{k} JOIN e{k} ON r{k}.reach = e{k}.a)",
            f"c{k} AS (SELECT p.*, coalesce((SELECT min(reach) FROM r{k} r WHERE r.id = p.id), p.id) AS component FROM {part} p)",
            f"s{k} AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM c{k})",
            f"t{k} AS (SELECT * FROM s{k} WHERE n <= 50 OR i % greatest(1, n // 50) = 0)",
            f"w{k} AS (SELECT a.component FROM t{k} a JOIN t{k} b USING (component) GROUP BY 1 HAVING max({_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')}) > 30)",
            f"p{k} AS (SELECT * REPLACE (component AS part) FROM c{k} WHERE component IN (SELECT component FROM w{k}))",
            f"q{k} AS (SELECT id, lat, lon, component FROM c{k} " + (f"WHERE component NOT IN (SELECT component FROM w{k})" if km > 2.5 else "") + ")",
        ]
        ctes[-2] = f"p{k} AS (SELECT * EXCLUDE (part, component), component AS part FROM c{k} WHERE component IN (SELECT component FROM w{k}))"
        part = f"p{k}"
    return ", ".join(ctes) + ", parts AS (SELECT id, component FROM q1 UNION ALL SELECT id, component FROM q2 UNION ALL SELECT id, component FROM q3)"


_ELIGIBLE = """SELECT f.id, lat, lon, fueltype, tech, capacity, name FROM (SELECT *, coalesce(technology, '') AS tech FROM candidate_index WHERE entry_type = 'individual' AND capacity >= 1 AND lat IS NOT NULL AND lon IS NOT NULL AND fueltype IN ('Wind', 'Solar', 'Biogas')) f
SEMI JOIN (SELECT fueltype, tech FROM (SELECT *, coalesce(technology, '') AS tech FROM candidate_index WHERE entry_type = 'individual' AND capacity >= 1 AND lat IS NOT NULL AND lon IS NOT NULL AND fueltype IN ('Wind', 'Solar', 'Biogas')) GROUP BY ALL HAVING count(*) >= 3) USING (fueltype, tech)"""


@query(f"WITH RECURSIVE {_split_sql('SELECT id, lat, lon FROM candidate_index WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)')} SELECT id, component FROM parts")
def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, split where a group is wider than 30 km."""
    points = table(spark, sf_dir, "candidate_index").filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)")
    return components.clusters(points, "id")


@query(f"""WITH RECURSIVE {_split_sql(_ELIGIBLE, "a.fueltype = b.fueltype AND a.tech = b.tech")}, g AS (SELECT x.fueltype, x.tech AS technology, component, count(*) AS n_plants, sum(capacity) AS capacity, avg(lat) AS lat, avg(lon) AS lon, array_to_string(list_sort(list(x.id)), ',') AS source_ids FROM ({_ELIGIBLE}) x JOIN parts USING (id) GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT row_number() OVER (ORDER BY fueltype, technology, component) + 9999999 AS cluster_id, fueltype, technology, component, n_plants, round(capacity, 4) AS capacity, round(lat, 4) AS lat, round(lon, 4) AS lon, source_ids FROM g""")
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster candidates for the index: eligible plants of one fuel and technology, joined, split and summed up."""
    plants = registry.eligible(table(spark, sf_dir, "candidate_index").filter("entry_type = 'individual'"))
    out = registry.cluster_rows(plants, components.clusters(plants, "id", within=("fueltype", "technology")))
    return out.select("cluster_id", "fueltype", "technology", "component", "n_plants", *[F.round(c, 4).alias(c) for c in ("capacity", "lat", "lon")], "source_ids")


_WIKI = "w AS (SELECT wiki_id, betroffene_anlage, matched_id, lat, lon FROM matches_wikipedia WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0))"
_NEAR = f"""WITH {_IDX}, {_WIKI}, d AS (SELECT wiki_id, id, {_HAV.format('w.lat', 'w.lon', 'i.lat', 'i.lon')} AS km FROM w, i)"""


@query(_NEAR + "SELECT wiki_id AS q_id, id AS p_id, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY km, id) AS rn FROM d WHERE km < 5) WHERE rn = 1")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_within(table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "candidate_index"), "wiki_id", "id", 5.0).withColumn("km", F.round("km", 4))


@query(_NEAR + "SELECT wiki_id AS q_id, id AS p_id, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY km, id) AS rn FROM d) WHERE rn = 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "candidate_index"), "wiki_id", "id").withColumn("km", F.round("km", 4))


@query(_NEAR + "SELECT wiki_id AS q_id, count(*) AS n_members, array_to_string(list_sort(list(id)), ',') AS matched_id, CAST(round(sum(CAST(coalesce(capacity, 0) AS DECIMAL(20, 6))), 1) AS DOUBLE) AS total_mw FROM d JOIN (SELECT id, capacity FROM candidate_index) USING (id) WHERE km <= 10 GROUP BY wiki_id")
def radius_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.gathered(table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "candidate_index"), "wiki_id", "id", 10.0, "capacity").select("q_id", "n_members", "matched_id", "total_mw")


_TOKENS = f"""pw AS (SELECT DISTINCT id, lat, lon, unnest(string_split({_plain('name')}, ' ')) AS w FROM candidate_index WHERE fueltype IN ('Wind', 'Solar', 'Biogas', 'Hydro', 'Solid Biomass') AND entry_type = 'individual'),
cw AS (SELECT DISTINCT cluster_id, unnest(list_filter(string_split_regex(replace({_plain('betroffene_anlage')}, '-', ' '), '\\s+'), lambda w: w NOT IN ({_PLACE_STOPS}) AND NOT regexp_full_match(w, '[0-9]+|t[0-9]+') AND length(w) >= 4)) AS w FROM matches_cluster),
t AS (SELECT DISTINCT cluster_id, id, lat, lon FROM cw JOIN pw USING (w) WHERE length(w) >= 4)"""


def _token_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    plants = table(spark, sf_dir, "candidate_index").filter("entry_type = 'individual' AND fueltype IN ('Wind', 'Solar', 'Biogas', 'Hydro', 'Solid Biomass')")
    words = plants.select("id", "lat", "lon", F.explode(F.array_distinct(F.split(text.plain_name(F.col("name")), " "))).alias("w")).filter(F.length("w") >= 4)
    asked = table(spark, sf_dir, "matches_cluster").select("cluster_id", F.explode(F.array_distinct(text.place_words(F.col("betroffene_anlage")))).alias("w"))
    return asked.join(words, "w").select("cluster_id", "id", "lat", "lon").distinct()


@query(f"WITH {_TOKENS} SELECT cluster_id, id FROM t")
def token_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewable plants whose name shares a word with the cluster's place."""
    return _token_gather(spark, sf_dir).select("cluster_id", "id")


@query(f"""WITH {_TOKENS}, n AS (SELECT cluster_id, count(*) AS gathered FROM t GROUP BY 1), l AS (SELECT * FROM t WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
c AS (SELECT a.cluster_id, a.id AS centre, count(*) AS core FROM l a JOIN l b ON a.cluster_id = b.cluster_id AND {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 25 GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY core DESC, centre) AS rn FROM c) WHERE rn = 1)
SELECT n.cluster_id, centre, gathered, coalesce(core, 0) AS core, coalesce(core, 0) > 0 AND (gathered <= 3 OR core >= 0.6 * gathered) AS coherent FROM n LEFT JOIN b ON n.cluster_id = b.cluster_id""")
def dominant_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _token_gather(spark, sf_dir)
    keyed = points.withColumn("key", F.struct("cluster_id", "id"))
    return spatial.densest_balls(keyed, "cluster_id", "key").withColumn("centre", F.col("centre.id"))


# Decisions

@query(f"WITH {_RESOLVED} SELECT name, entry_type, confidence, matched_id FROM resolved")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("name", "entry_type", "confidence", "matched_id")


@query(f"""WITH m AS (SELECT name, min(id) AS matched_id FROM (SELECT unnest(string_split(match_names, ' | ')) AS name, id FROM candidate_index) GROUP BY name),
a AS (SELECT m.name, m.matched_id, c.name AS matched_name, c.capacity, c.lat, c.lon FROM m JOIN candidate_index c ON m.matched_id = c.id),
x AS (SELECT DISTINCT betroffene_anlage AS n FROM matches_exact WHERE {_several('betroffene_anlage')}),
p AS (SELECT n, unnest({_parts('n')}) AS part, generate_subscripts({_parts('n')}, 1) AS i FROM x),
j AS (SELECT p.*, a.* FROM p LEFT JOIN a ON p.part = a.name)
SELECT n AS betroffene_anlage, count(*) AS n_parts, count(matched_id) AS n_matched, string_agg(matched_id, ',' ORDER BY i) AS matched_id, string_agg(matched_name, ' + ' ORDER BY i) AS matched_name,
  round(sum(capacity), 4) AS capacity_mw, CASE WHEN count(matched_id) = count(*) THEN 'high' ELSE 'medium' END AS confidence FROM j GROUP BY n HAVING count(matched_id) > 0""")
def compose_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles told by the plants whose name their parts are."""
    index = table(spark, sf_dir, "candidate_index")
    by_name = index.select(F.explode(F.split("match_names", r" \| ")).alias("betroffene_anlage"), "id").groupBy("betroffene_anlage").agg(F.min("id").alias("matched_id"))
    matches = by_name.join(index.select(F.col("id").alias("matched_id"), F.col("name").alias("matched_name"), "capacity", "lat", "lon"), "matched_id")
    bundles = table(spark, sf_dir, "matches_exact").select("betroffene_anlage").distinct()
    out = decisions.composed(bundles, matches)
    return out.drop("lat", "lon").withColumn("capacity_mw", F.round("capacity_mw", 4))


_PLACES = "pl AS (SELECT DISTINCT ON (betroffene_anlage) betroffene_anlage, lat, lon FROM matches_wikipedia WHERE lat IS NOT NULL AND lon IS NOT NULL ORDER BY betroffene_anlage, wiki_id)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    wiki = table(spark, sf_dir, "matches_wikipedia").filter("lat IS NOT NULL AND lon IS NOT NULL")
    return entries.first_by(wiki, ["betroffene_anlage"], "wiki_id", ["lat", "lon"])


@query(f"""WITH {_PLACES}, c AS (SELECT match_id, e.betroffene_anlage, i.lat, i.lon FROM matches_exact e LEFT JOIN candidate_index i ON e.matched_id = i.id)
SELECT match_id, CASE WHEN c.lat IS NULL AND pl.lat IS NOT NULL THEN pl.lat ELSE c.lat END AS lat, CASE WHEN c.lat IS NULL AND pl.lat IS NOT NULL THEN pl.lon ELSE c.lon END AS lon,
  CASE WHEN c.lat IS NULL AND pl.lat IS NOT NULL THEN 'geocode' WHEN c.lat IS NOT NULL THEN 'index' ELSE 'none' END AS coord_source FROM c LEFT JOIN pl USING (betroffene_anlage)""")
def backfill_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "candidate_index").select(F.col("id").alias("matched_id"), "lat", "lon")
    rows = table(spark, sf_dir, "matches_exact").select("match_id", "betroffene_anlage", "matched_id").join(index, "matched_id", "left").withColumn("coord_source", F.lit(None).cast("string"))
    return decisions.filled_places(rows, _places(spark, sf_dir), "betroffene_anlage").select("match_id", "lat", "lon", "coord_source")


_CONFIRMED = f"""{_PLACES}, c AS (SELECT w.wiki_id, w.betroffene_anlage, i.lat, i.lon FROM matches_wikipedia w JOIN candidate_index i ON w.matched_id = i.id),
d AS (SELECT wiki_id, {_HAV.format('c.lat', 'c.lon', 'pl.lat', 'pl.lon')} AS km FROM c LEFT JOIN pl USING (betroffene_anlage))"""


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "candidate_index").select(F.col("id").alias("matched_id"), "lat", "lon")
    rows = table(spark, sf_dir, "matches_wikipedia").select("wiki_id", "betroffene_anlage", "matched_id").join(index, "matched_id")
    other = _places(spark, sf_dir).join(rows.select("wiki_id", "betroffene_anlage"), "betroffene_anlage").select("wiki_id", "lat", "lon")
    return spatial.location_confirmed(rows.select("wiki_id", "lat", "lon"), other, "wiki_id")


@query(f"WITH {_CONFIRMED} SELECT wiki_id, CASE WHEN km IS NULL THEN 'no_geocode' WHEN km <= 30 THEN 'confirmed' ELSE 'disagree' END AS coord_check, round(km, 1) AS check_km FROM d")
def confirm_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir)


@query(f"WITH {_CONFIRMED} SELECT round(median(k), 4) AS median_km, round(quantile_cont(k, 0.9), 4) AS p90_km, max(k) AS max_km FROM (SELECT round(km, 1) AS k FROM d)")
def confirm_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir).agg(F.round(F.median("check_km"), 4).alias("median_km"), F.round(F.percentile("check_km", 0.9), 4).alias("p90_km"), F.max("check_km").alias("max_km"))


@query(_NEAR + """, b AS (SELECT wiki_id, min(km) AS km FROM d GROUP BY 1), j AS (SELECT w.wiki_id, w.matched_id IS NOT NULL AS had, i.lat IS NOT NULL AS place, b.km FROM w LEFT JOIN candidate_index i ON w.matched_id = i.id LEFT JOIN b ON w.wiki_id = b.wiki_id)
SELECT wiki_id, v AS verdict, CASE v WHEN 'agree' THEN 'high' WHEN 'alone' THEN 'none' ELSE 'low' END AS confidence FROM (
  SELECT wiki_id, CASE WHEN had AND place THEN CASE WHEN km <= 5 THEN 'agree' ELSE 'disagree' END WHEN km <= 5 THEN 'nearby' ELSE 'alone' END AS v FROM j)""")
def wiki_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    wiki, index = table(spark, sf_dir, "matches_wikipedia"), table(spark, sf_dir, "candidate_index")
    near = spatial.nearest_within(wiki, index, "wiki_id", "id", 5.0, inclusive=True).select(F.col("q_id").alias("wiki_id"), "km")
    located = wiki.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)").select("wiki_id", "matched_id")
    joined = located.join(index.select(F.col("id").alias("matched_id"), F.col("lat").alias("_lat")), "matched_id", "left").join(near, "wiki_id", "left")
    verdict = decisions.located_verdict(F.col("matched_id").isNotNull(), F.col("_lat").isNotNull(), F.col("km"))
    return joined.select("wiki_id", verdict.alias("verdict")).withColumn("confidence", decisions.verdict_confidence(F.col("verdict")))


@query("""SELECT 'capacity_not_negative' AS "check", count(*) FILTER (NOT coalesce(capacity >= 0, FALSE)) AS violations FROM candidate_index
UNION ALL SELECT 'has_name', count(*) FILTER (NOT coalesce(length(match_names) > 0, FALSE)) FROM candidate_index
UNION ALL SELECT 'known_type', count(*) FILTER (NOT coalesce(entry_type IN ('individual', 'cluster'), FALSE)) FROM candidate_index""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.check(table(spark, sf_dir, "candidate_index"), capacity_not_negative=F.col("capacity") >= 0, has_name=F.length("match_names") > 0, known_type=F.col("entry_type").isin("individual", "cluster"))


# Volumes

@query(f"WITH {_DAY} SELECT row_id, strftime(day, '%Y-%m-%d') AS day, change FROM dayed")
def local_day_berlin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = written_moment(F.col("beginn_datum"), F.col("beginn_uhrzeit"))
    return table(spark, sf_dir, "build_data").select("row_id", F.date_format(local_day(wall, F.col("zeitzone_von")), "yyyy-MM-dd").alias("day"), clock_change(wall, "Europe/Berlin").alias("change"))


@query(f"WITH {_VOLUMES} SELECT name, day, round(CAST(sum(CAST(inc AS DECIMAL(24, 6))) AS DOUBLE), 3) AS inc, round(CAST(sum(CAST(dec AS DECIMAL(24, 6))) AS DOUBLE), 3) AS dec FROM volumes GROUP BY name, day")
def daily_inc_dec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.daily(volumes.volumes(table(spark, sf_dir, "build_data")), "name")


_MAPPED = f"""{_VOLUMES}, {_RESOLVED}, mapped AS (SELECT v.*, r.name IS NOT NULL AS known, coalesce(r.confidence, 'none') AS confidence, r.entry_type, CASE WHEN r.lat IS NOT NULL AND r.lon IS NOT NULL THEN 'mapped' WHEN trim(coalesce(r.entry_type, '')) = 'countertrade' THEN 'boerse' ELSE 'not_identified' END AS category FROM volumes v LEFT JOIN resolved r ON v.name = r.name)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = volumes.volumes(table(spark, sf_dir, "build_data"))
    r = maybe_broadcast(resolved(spark, sf_dir))
    return calls.join(r, "name", "left").withColumn("category", volumes.map_category(F.col("entry_type"), F.col("lat"), F.col("lon"))).withColumn("confidence", F.coalesce("confidence", F.lit("none")))


@query(f"WITH {_MAPPED} SELECT category, day, round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE), 3) AS mwh FROM mapped WHERE category <> 'mapped' GROUP BY 1, 2")
def unmapped_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).filter("category <> 'mapped'").groupBy("category", "day").agg(F.round(volumes.exact_sum("mwh"), 3).alias("mwh"))


@query(f"""WITH {_MAPPED} SELECT min(day) AS date_min, max(day) AS date_max, count(DISTINCT CASE WHEN category = 'mapped' THEN name END) AS n_plants, round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE), 1) AS total_mwh,
round(CAST(sum(CAST(CASE WHEN category = 'mapped' THEN mwh ELSE 0 END AS DECIMAL(24, 6))) AS DOUBLE), 1) AS mapped_mwh, round(CAST(sum(CAST(CASE WHEN category = 'boerse' THEN mwh ELSE 0 END AS DECIMAL(24, 6))) AS DOUBLE), 1) AS boerse_mwh, round(CAST(sum(CAST(CASE WHEN category = 'not_identified' THEN mwh ELSE 0 END AS DECIMAL(24, 6))) AS DOUBLE), 1) AS not_identified_mwh FROM mapped""")
def dashboard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.round(volumes.exact_sum(F.when(F.col("category") == c, F.col("mwh")).otherwise(0.0)), 1).alias(f"{c}_mwh")
    return _mapped(spark, sf_dir).agg(F.min("day").alias("date_min"), F.max("day").alias("date_max"), F.count_distinct(F.when(F.col("category") == "mapped", F.col("name"))).alias("n_plants"), F.round(volumes.exact_sum("mwh"), 1).alias("total_mwh"), of("mapped"), of("boerse"), of("not_identified"))


@query(f"""{_CATEGORISED} SELECT d.category, coalesce(round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE), 3), 0) AS mwh FROM (SELECT unnest({_CATS}) AS category) d LEFT JOIN cat USING (category) GROUP BY d.category""")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.category_totals(categorised(spark, sf_dir)).withColumn("mwh", F.round("mwh", 3))


_YEAR = ", ".join(f"""coalesce(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) FILTER (category = '{c}') AS DOUBLE), 0) AS "{c}" """ for c in _CATS)


@query(f"""{_CATEGORISED}, y AS (SELECT year, {_YEAR} FROM cat GROUP BY year) SELECT year, {', '.join(f'round("{c}", 3) AS "{c}"' for c in _CATS)} FROM y""")
def year_category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = volumes.year_table(categorised(spark, sf_dir))
    return t.select("year", *[F.round(c, 3).alias(c) for c in _CATS])


_YEAR_SUM = " + ".join(f'"{c}"' for c in _CATS)


@query(f"""{_CATEGORISED}, y AS (SELECT year, {_YEAR} FROM cat GROUP BY year) SELECT year, {', '.join(f'round(100 * "{c}" / nullif({_YEAR_SUM}, 0), 4) AS "{c}"' for c in _CATS)} FROM y""")
def year_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = volumes.row_shares(volumes.year_table(categorised(spark, sf_dir)), _CATS)
    return shares.select("year", *[F.round(c, 4).alias(c) for c in _CATS])


@query(f"""{_CATEGORISED}, s AS (SELECT CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE) AS t, CAST(sum(CAST(CASE WHEN starts_with(category, 'matched') THEN mwh ELSE 0 END AS DECIMAL(24, 6))) AS DOUBLE) AS m, CAST(sum(CAST(CASE WHEN category = 'aggregate' THEN mwh ELSE 0 END AS DECIMAL(24, 6))) AS DOUBLE) AS a FROM cat)
SELECT round(t, 2) AS total_mwh, round(100 * m / t, 4) AS matched_pct, round(100 * a / t, 4) AS aggregate_pct, round(100 * m / (t - a), 4) AS attributable_pct FROM s""")
def volume_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = volumes.key_figures(categorised(spark, sf_dir))
    return k.select(F.round("total_mwh", 2).alias("total_mwh"), *[F.round(c, 4).alias(c) for c in k.columns[1:]])


@query(f"""{_CATEGORISED}, c AS (SELECT year, category, round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE) / 1e6, 6) AS twh FROM cat WHERE starts_with(category, 'matched') GROUP BY 1, 2) SELECT year, category, twh FROM c""")
def confidence_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = categorised(spark, sf_dir).filter(F.startswith("category", F.lit("matched")))
    return matched.groupBy("year", "category").agg(F.round(volumes.exact_sum("mwh") / 1e6, 6).alias("twh"))


@query(f"""{_CATEGORISED} SELECT name, category, round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE), 3) AS mwh FROM cat WHERE NOT starts_with(category, 'matched') AND name IS NOT NULL GROUP BY 1, 2 ORDER BY CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE) DESC, name, category LIMIT 15""")
def top_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = categorised(spark, sf_dir).filter(~F.startswith("category", F.lit("matched")) & F.col("name").isNotNull())
    return volumes.largest(rest, ["name", "category"]).withColumn("mwh", F.round("mwh", 3))


@query(f"{_CATEGORISED}, g AS (SELECT category, CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE) AS mwh FROM cat GROUP BY 1) SELECT category, round(mwh, 3) AS mwh, round(100 * mwh / sum(mwh) OVER (), 4) AS pct FROM g")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.shares_of_total(categorised(spark, sf_dir), "category").select("category", F.round("mwh", 3).alias("mwh"), F.round("pct", 4).alias("pct"))


_WINDOW = ("2022-01-01", "2022-06-30")


@query(f"""WITH {_MAPPED}, d AS (SELECT name, confidence, day, round(CAST(sum(CAST(inc AS DECIMAL(24, 6))) AS DOUBLE), 3) AS inc, round(CAST(sum(CAST(dec AS DECIMAL(24, 6))) AS DOUBLE), 3) AS dec FROM mapped WHERE name IS NOT NULL GROUP BY ALL),
s AS (SELECT (SELECT max(t) FROM (SELECT CAST(sum(CAST(inc AS DECIMAL(24, 6))) AS DOUBLE) + CAST(sum(CAST(dec AS DECIMAL(24, 6))) AS DOUBLE) AS t FROM d GROUP BY name)) / (SELECT date_diff('day', min(day), max(day)) + 1 FROM d) * (date_diff('day', DATE '{_WINDOW[0]}', DATE '{_WINDOW[1]}') + 1) AS ref),
w AS (SELECT name, confidence, round(CAST(sum(CAST(inc AS DECIMAL(24, 6))) AS DOUBLE), 3) AS inc, round(CAST(sum(CAST(dec AS DECIMAL(24, 6))) AS DOUBLE), 3) AS dec FROM d WHERE day BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}' GROUP BY ALL)
SELECT name, inc, dec, confidence IN ('high', 'medium') AS shown, round(CASE WHEN inc + dec <= 0 THEN 0 ELSE greatest(3.0, least(46.0, 46.0 * sqrt((inc + dec) / ref))) END, 4) AS radius,
  CASE WHEN inc + dec <= 0 OR abs(inc - dec) / (inc + dec) < 0.1 THEN 'balanced' WHEN inc > dec THEN 'increase' ELSE 'decrease' END AS balance FROM w, s""")
def window_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = volumes.daily(_mapped(spark, sf_dir).filter(F.col("name").isNotNull()), "name", "confidence")
    return volumes.window_view(rows, *_WINDOW, ["high", "medium"]).withColumn("radius", F.round("radius", 4))


@query(f"""WITH {_VOLUMES}, e AS (SELECT min(day) AS a, max(day) AS b FROM volumes) SELECT CAST(x AS DATE) AS day, CAST(date_diff('day', a, CAST(x AS DATE)) AS INTEGER) AS i FROM e, generate_series(CAST((SELECT a FROM e) AS TIMESTAMP), CAST((SELECT b FROM e) AS TIMESTAMP), INTERVAL 1 DAY) AS s(x)""")
def day_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.day_axis(volumes.volumes(table(spark, sf_dir, "build_data"))).select("day", "i")


@query(f"""WITH {_VOLUMES} SELECT DISTINCT date_trunc('month', day)::DATE AS month, min(day) OVER w AS first_day, max(day) OVER w AS last_day FROM volumes WINDOW w AS (PARTITION BY date_trunc('month', day))""")
def month_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = volumes.volumes(table(spark, sf_dir, "build_data"))
    return rows.groupBy(F.trunc("day", "MM").alias("month")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_NICE = "(CASE WHEN {0} <= 0 THEN 0.0 ELSE pow(10.0, floor(log10({0}))) * CASE WHEN {0} / pow(10.0, floor(log10({0}))) < 1.5 THEN 1.0 WHEN {0} / pow(10.0, floor(log10({0}))) < 3 THEN 2.0 WHEN {0} / pow(10.0, floor(log10({0}))) < 7 THEN 5.0 ELSE 10.0 END END)"


@query(f"""WITH {_VOLUMES}, t AS (SELECT name, round(CAST(sum(CAST(mwh AS DECIMAL(24, 6))) AS DOUBLE), 3) AS mwh FROM volumes WHERE name IS NOT NULL GROUP BY name), n AS (SELECT name, mwh, {_NICE.format('mwh')} AS top FROM t)
SELECT name, mwh, array_to_string(list_sort(list_distinct(list_filter([{_NICE.format('(top / 25)')}, {_NICE.format('(top / 5)')}, top], lambda v: v > 0))).list_transform(lambda v: printf('%.4f', v)), ' ') AS legend,
  CASE WHEN mwh >= 1e6 THEN printf('%.2f TWh', mwh / 1e6) WHEN mwh >= 1e3 THEN printf('%.1f GWh', mwh / 1e3) ELSE CAST(CAST(round(mwh) AS BIGINT) AS VARCHAR) || ' MWh' END AS label FROM n""")
def nice_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = volumes.volumes(table(spark, sf_dir, "build_data")).filter(F.col("name").isNotNull()).groupBy("name").agg(F.round(volumes.exact_sum("mwh"), 3).alias("mwh"))
    legend = F.array_join(F.transform(figures.legend_values(F.col("mwh")), lambda v: F.format_string("%.4f", v)), " ")
    return t.select("name", "mwh", legend.alias("legend"), figures.energy_label(F.col("mwh")).alias("label"))


# More of the stages

@query(f"""WITH m AS (SELECT cluster_id, unnest(string_split(matched_id, ',')) AS id FROM matches_cluster WHERE matched_id IS NOT NULL)
SELECT cluster_id, count(*) AS n_members, coalesce(array_to_string(list_sort(list(DISTINCT fueltype) FILTER (fueltype IS NOT NULL)), ','), '') AS fueltypes, {_sum_sql('capacity')} AS capacity FROM m LEFT JOIN candidate_index c ON m.id = c.id GROUP BY cluster_id""")
def member_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the members of each cluster are: their fuels and summed capacity."""
    members = table(spark, sf_dir, "matches_cluster").select("cluster_id", F.explode(F.split("matched_id", ",")).alias("id"))
    joined = members.join(table(spark, sf_dir, "candidate_index").select("id", "fueltype", "capacity"), "id", "left")
    return joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_set("fueltype")), ",").alias("fueltypes"), volumes.exact_sum("capacity").alias("capacity"))


@query("""SELECT count(*) AS n, count(*) FILTER (matched_id IS NOT NULL) AS n_matched, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS n_located, count(DISTINCT matched_id) AS n_ids, count(*) FILTER (needs_review = 'yes') AS n_review FROM matches_wikipedia""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.coalesce(F.col("needs_review") == "yes", F.lit(False))
    return table(spark, sf_dir, "matches_wikipedia").agg(F.count(F.lit(1)).alias("n"), F.count("matched_id").alias("n_matched"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("n_located"), F.count_distinct("matched_id").alias("n_ids"), F.count_if(review).alias("n_review"))


@query("SELECT cluster_id, betroffene_anlage FROM matches_cluster WHERE matched_id IS NULL OR matched_id = '' OR confidence = 'low'")
def residual_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are still open: without an id, or of low confidence."""
    return table(spark, sf_dir, "matches_cluster").filter("matched_id IS NULL OR matched_id = '' OR confidence = 'low'").select("cluster_id", "betroffene_anlage")


_GAPS = _NEAR + """, ref AS (SELECT DISTINCT w2.wiki_id FROM matches_wikipedia w2 JOIN candidate_index i2 ON w2.matched_id = i2.id WHERE w2.wiki_id % 3 <> 0),
missing AS (SELECT * FROM matches_wikipedia WHERE wiki_id NOT IN (SELECT wiki_id FROM ref)),
n AS (SELECT wiki_id, id, km FROM (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY km, id) AS rn FROM d WHERE km < 0.5 AND wiki_id IN (SELECT wiki_id FROM missing)) WHERE rn = 1)"""


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plant index with the ids of the other registry that it already refers to: of the matched rows two thirds."""
    held = table(spark, sf_dir, "matches_wikipedia").filter("matched_id IS NOT NULL AND wiki_id % 3 <> 0").groupBy(F.col("matched_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("wiki_id").cast("string"))).alias("known"))
    return table(spark, sf_dir, "candidate_index").join(held, "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


@query(_GAPS + " SELECT CAST(m.wiki_id AS VARCHAR) AS id, n.id AS reconciled FROM missing m LEFT JOIN n USING (wiki_id)")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the index doesn't refer to, reconciled with a plant strictly closer than half a kilometre, or new (null)."""
    other = table(spark, sf_dir, "matches_wikipedia").select(F.col("wiki_id").alias("id"), "lat", "lon")
    near, new = registry.filled_gaps(_spine(spark, sf_dir), other, F.col("known"))
    return near.select(F.col("other_id").alias("id"), F.col("id").alias("reconciled")).unionByName(new.select("id", F.lit(None).cast("string").alias("reconciled")))


@query(_GAPS + """, sp AS (SELECT i.id, any_value(i.name) AS name, any_value(i.fueltype) AS fueltype, any_value(i.capacity) AS capacity, any_value(i.lat) AS lat, list(DISTINCT CAST(r.wiki_id AS VARCHAR)) FILTER (r.wiki_id IS NOT NULL) AS known
  FROM candidate_index i LEFT JOIN matches_wikipedia r ON r.matched_id = i.id AND r.wiki_id % 3 <> 0 GROUP BY i.id),
ad AS (SELECT id, list(CAST(wiki_id AS VARCHAR)) AS more, min(CAST(wiki_id AS VARCHAR)) AS first_ FROM n GROUP BY id)
SELECT sp.id, name, coalesce(fueltype, CASE WHEN ad.id IS NOT NULL THEN 'Wind' END) AS fueltype, CASE WHEN coalesce(capacity, 0) = 0 AND ad.id IS NOT NULL THEN 1.5 ELSE capacity END AS capacity, lat,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(known, []), coalesce(more, [])))), ',') AS known FROM sp LEFT JOIN ad USING (id)
UNION ALL SELECT CAST(wiki_id AS VARCHAR), betroffene_anlage, 'Wind', 1.5, lat, CAST(wiki_id AS VARCHAR) FROM missing m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.wiki_id = m.wiki_id)""")
def filled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the gaps are filled: reconciled rows enrich their plant, the others are new plants."""
    other = table(spark, sf_dir, "matches_wikipedia").select(F.col("wiki_id").alias("id"), F.col("betroffene_anlage").alias("name"), F.lit("Wind").alias("fueltype"), F.lit(1.5).alias("capacity"), "lat", "lon")
    out = registry.with_gaps_filled(_spine(spark, sf_dir), other, "known")
    return out.select("id", "name", "fueltype", "capacity", "lat", F.array_join("known", ",").alias("known"))


_CROSSED = f"""{_INDEX}, cross_ AS (SELECT b.candidate, min(i.candidate) AS other FROM bn b JOIN idx i USING (norm) WHERE b.norm <> '' GROUP BY b.candidate),
br AS (SELECT norm, coalesce(other, candidate) AS candidate, CASE WHEN other IS NULL THEN 'bnetza' ELSE 'index' END AS id_source FROM bn LEFT JOIN cross_ USING (candidate) WHERE norm IS NOT NULL AND norm <> ''),
al AS (SELECT norm, candidate, id_source FROM idx WHERE norm IS NOT NULL AND norm <> '' UNION SELECT * FROM br)
SELECT norm, count(DISTINCT (candidate, id_source)) AS n_candidates FROM al GROUP BY norm"""


@query(f"WITH {_CROSSED}")
def bridged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each normal form when registry ids that the index also has are told by the index's id."""
    idx = lookup.name_index(table(spark, sf_dir, "candidate_index"), "id", F.split("match_names", r" \| "), "index")
    bn = lookup.name_index(table(spark, sf_dir, "bnetza_lookup"), "mastr_id", F.array("anzeigename"), "bnetza")
    crossing = bn.select("candidate", "norm").join(idx.select("norm", F.col("candidate").alias("other")), "norm").select("candidate", "other")
    both = idx.unionByName(lookup.bridged(bn, crossing)).distinct()
    return both.groupBy("norm").agg(F.count_distinct("candidate", "id_source").alias("n_candidates"))


@query(f"""WITH {_VOLUMES} SELECT name, day, round({_sum_sql('inc')}, 3) AS inc, round({_sum_sql('dec')}, 3) AS dec, count(*) AS n_calls FROM volumes WHERE name IS NOT NULL GROUP BY name, day""")
def streaming_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily volumes by a stream over the table's files, each run from its start."""
    calls = stream.read_calls(spark, f"{sf_dir}/build_data.parque[t]", table(spark, sf_dir, "build_data").schema)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    days = stream.daily_stream(calls.filter("trim(betroffene_anlage) <> ''"), late="36500 days")
    stream.upsert_days(days, f"{folder}/days", f"{folder}/state").awaitTermination()
    rows = stream.read_days(spark, f"{folder}/days").filter("name IS NOT NULL")
    return rows.select("name", "day", F.round("inc", 3).alias("inc"), F.round("dec", 3).alias("dec"), "n_calls")


@query()
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that tells a chooser each name's candidates, the whole shortlist of twenty."""
    index = table(spark, sf_dir, "candidate_index").select(F.col("id").alias("cand_id"), F.col("name").alias("cand_name"), F.col("fueltype").alias("cand_fueltype"), F.col("capacity").alias("cand_capacity"))
    best = _shortlist(spark, sf_dir).withColumnRenamed("id", "cand_id")
    return resolvers.prompt_lines(best.join(index, "cand_id"), "norm")


@query()
def pipeline_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline from the raw calls to one row a name."""
    out = pipeline.resolve(table(spark, sf_dir, "build_data"), table(spark, sf_dir, "candidate_index"), table(spark, sf_dir, "bnetza_lookup"), _places(spark, sf_dir))
    return out.final
