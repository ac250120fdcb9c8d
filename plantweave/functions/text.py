"""Names as columns: normal forms, words, parts, first-match rules, numbers and texts of exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of grid operators, words that tell no place, and rules of the entry types, in order.
GRID_PREFIXES = "50H|TTG|TNG|AMP|TBW"
STOP_WORDS = (
    "kraftwerk kw hkw hkwm gud gtkw gt dt bhkw kwk psw pss ms ro ready kng cluster standort block "
    "windpark wp wpk windkraftanlage wka wind pv pva photovoltaik solarpark solar park anlage freiflache "
    "shn ava avacon edis wema mns ten westnetz lew vse syna nike verteilnetz "
    "gmbh co kg ug ag mbh und der die das"
).split()
PLACE_STOP_WORDS = "cluster nwak bag croc sc ee pool shn ava ttg tng amp tbw avk bwp wp windpark wind nord sud süd west ost".split()
ENTRY_RULES = [
    ("countertrade", r"(?iu)^\s*Börse"),
    ("emergency", r"(?iu)Notfall"),
    ("foreign", r"(?iu)Vianden|K[üu]htai|illwerke|Vorarlberger|Ilwerke"),
    ("cluster", r"(?iuU)\bCluster\b"),
    ("control_reserve", r"(?iuU)_CR_|_CR\b"),
    ("substation", r"(?iuU)\bUW\b|Umspannwerk"),
    ("regional_renewable", r"(?iuU)\bEE\b"),
]
_LETTER = "[A-Za-zÄÖÜäöüß]"
TECHNOLOGY_RULES = [
    ("Wind", rf"(?iu)(?<!{_LETTER})WIND(?!{_LETTER})"),
    ("Solar", rf"(?iu)PHOTOVOLTAIK|(?<!{_LETTER})PV(?!{_LETTER})"),
    ("Other renewable", r"(?iu)SONSTIGE_EE"),
    ("Conventional", r"(?iu)KONVENTIONELL"),
    ("Wind", r"(?iuU)\bOWP\b"),
    ("Wind", (r"(?iuU)\bUW\b|Umspannwerk", r"(?iu)büttel|buettel|diele|dörpen|dorpen|emden|garrel|baltic")),
]
FUELS_OF_ENERGY = {
    "Konventionell": ["Natural Gas", "Hard Coal", "Lignite", "Oil", "Waste", "Other"],
    "Erneuerbar": ["Solar", "Wind", "Hydro", "Biogas", "Solid Biomass", "Geothermal"],
}


#: All white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(WHITE))


def filled(c: Column) -> Column:
    """The stripped text; null if nothing is left or if it reads nan."""
    s = stripped(c)
    return F.when((s != "") & (s != "nan"), s)


def plain_name(c: Column, any_case: bool = True, underscores: bool = True) -> Column:
    """Lower-case name without a grid operator's prefix, brackets and punctuation other than hyphens.

    any_case: the prefix counts in any letter case. underscores: they part words, else they are letters. The form of
    queries takes both, the form of the registry neither. Null stays null.
    """
    s = F.regexp_replace(stripped(c), rf"(?U{'iu' if any_case else ''})^\s*({GRID_PREFIXES})\s+", "")
    s = F.translate(s, "_", " ") if underscores else s
    s = F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", " "), r"(?U)[^\w\s-]", " ")
    return F.lower(stripped(F.regexp_replace(s, r"(?U)\s+", " ")))


def core_name(c: Column, stop: Sequence[str] = STOP_WORDS, fall_back: bool = True) -> Column:
    """The plain name without stop words and turbine codes; if nothing is left, the plain name or the empty text."""
    plain = plain_name(c)
    kept = F.filter(F.split(plain, " "), lambda w: ~w.isin([*stop]) & ~w.rlike(r"^t\d+$"))
    core = F.array_join(kept, " ")
    return F.when(core == "", plain).otherwise(core) if fall_back else core


def place_words(c: Column, stop: Sequence[str] = PLACE_STOP_WORDS, least: int = 4) -> Column:
    """The words of a cluster's name that may tell its place."""
    words = F.split(F.translate(plain_name(c), "-", " "), r"\s+")
    return F.filter(words, lambda w: ~w.isin([*stop]) & ~w.rlike(r"^\d+$|^t\d+$") & (F.length(w) >= least))


def listed_parts(c: Column) -> Column:
    """The parts that commas part, if at least two hold a word of four letters; else an empty array."""
    parts = F.transform(F.split(c, ","), stripped)
    several = F.size(F.filter(parts, lambda p: p.rlike(_LETTER + "{4,}"))) >= 2
    return F.when(several, parts).otherwise(F.array().cast("array<string>"))


def first_rule(c: Column, rules: Sequence[tuple[str, str | tuple[str, ...]]], otherwise: Column) -> Column:
    """The label of the first rule whose pattern is found in c; of several patterns all must be."""
    out = otherwise
    for label, patterns in reversed(rules):
        found = F.lit(True)
        for pattern in (patterns,) if isinstance(patterns, str) else patterns:
            found &= c.rlike(pattern)
        out = F.when(found, F.lit(label)).otherwise(out)
    return out


def entry_type(c: Column) -> Column:
    return first_rule(c, ENTRY_RULES, F.when(F.size(listed_parts(c)) > 0, "multi_plant").otherwise("individual"))


def told_technology(c: Column) -> Column:
    return first_rule(c, TECHNOLOGY_RULES, F.lit(""))


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal comma; null if it is none, NaN included."""
    return F.nanvl(F.translate(stripped(c), ",", ".").try_cast("double"), F.lit(None).cast("double"))


def pick(c: Column, values: Mapping[str, str], otherwise: str) -> Column:
    """A constant dictionary applied to c."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(otherwise))


def fuels_allowed(energy: Column) -> Column:
    """The fuels that go with an energy category; null if the category sets no limit."""
    table = F.create_map(*[x for k, v in FUELS_OF_ENERGY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, energy)


def percent_encoded(c: Column) -> Column:
    """A URL path: all but letters, digits, slashes and . _ - ~ encoded."""
    out = F.url_encode(c)
    for form, path in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(path))
    return out


def html_escaped(c: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def known_confidence(c: Column) -> Column:
    """high, medium, low or none in lower case; none for null and blank."""
    s = F.lower(stripped(c))
    return F.when(F.coalesce(s, F.lit("")) == "", "none").otherwise(s)


def union_sorted(arrays: Column) -> Column:
    """An aggregate: the distinct texts of arrays, sorted, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(arrays)), lambda x: x != "")))


def union_cells(cells: Column) -> Column:
    """An aggregate: the distinct parts of comma-separated cells, sorted, as one cell; empty if there are none."""
    return F.array_join(union_sorted(F.transform(F.split(cells, ","), lambda x: F.trim(x))), ",")


def id_lists(project: Column, eic: Column) -> tuple[Column, Column, Column]:
    """(mastr, opsd, eic) ids of a cell that holds a dictionary of lists, and of the column of codes beside it.

    A cell that can't be read gives none. Empty codes and those that read nan are none.
    """
    read = F.from_json(project, "map<string,array<string>>", {"allowSingleQuotes": "true"})
    of = lambda k: F.coalesce(F.try_element_at(read, F.lit(k)), F.array().cast("array<string>"))
    mastr = F.transform(of("MASTR"), lambda x: F.replace(x, F.lit("MASTR-"), F.lit("")))
    code = F.when(eic.isNotNull() & ~eic.isin("", "nan", "{nan}"), F.array(eic)).otherwise(F.array().cast("array<string>"))
    return mastr, of("OPSD"), F.concat(of("ENTSOE"), code)
