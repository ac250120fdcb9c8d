"""Variant spellings of names: pigeonhole segment join, verified by banded edit distance.

If two texts differ by at most k edits and one is cut into k + 1 segments, at least one segment occurs in the other
unchanged. Only few places need to be looked at for it: with i segments before it and k - i after it, it is moved by
at most i characters as seen from the begin and by at most k - i as seen from the end (Li, Deng, Wang and Feng,
Pass-Join, 2011). One side's segments and the other side's substrings meet in an equality join; what meets is verified by an edit
distance in a band of width k. Shortened texts meet the beginnings of others in the same way. First the texts look
for known ones with at most one edit; only the rest looks farther, and then it is the few texts that look which have
many keys, not the many that are looked up. All keys are built from columns, no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Texts from these lengths on may differ by 1, 2 and 3 edits; 3 only from a known text. Shorter ones have no variants.
ONE, TWO, THREE = 5, 8, 12
#: Shortened texts of that length on are met by their beginnings.
LEAST_CUT = 4
#: Lengths of the beginnings by which a text meets the longer ones that begin with it: the longest that it has.
BEGINS = (8, 12, 16, 24, 32)
#: Most rounds of following chains, each of which doubles the steps.
ROUNDS = 40


def edits(length: int) -> int:
    return (length >= ONE) + (length >= TWO) + (length >= THREE)


# Keys are written as SQL: hundreds of small columns would each be built by a call into the JVM. n is the text's length.

def _segment(length: str, k: int, i: int) -> tuple[str, str]:
    """(begin, length) of segment i of the k + 1 segments of a text; the last ones are longer by one where it doesn't divide."""
    base, longer = f"(({length}) div {k + 1})", f"({k + 1} - ({length}) % {k + 1})"
    return f"({i} * {base} + greatest(0, {i} - {longer}))", f"({base} + if({i} >= {longer}, 1, 0))"


def _key(given: str, kind: str, length: str | int, i: int, text: str, begin: str | int, size: str | int) -> str:
    """The hash of a part of a text, null unless given."""
    return f"if({given}, xxhash64('{kind}', int({length}), {i}, substring({text}, int({begin}) + 1, int({size}))), NULL)"


def segment_keys(text: str, k: int, kind: str, given: str) -> list[str]:
    """The keys of a text's own segments."""
    return [_key(f"{given} AND n > {k}", kind, "n", i, text, *_segment("n", k, i)) for i in range(k + 1)]


def substring_keys(text: str, k: int, kind: str, given: str, least: int = 1) -> list[str]:
    """The keys of the substrings in which a segment of a text within k edits, of at least that length, may be found."""
    out = []
    for more in range(-k, k + 1):  # how much longer this text is than the other
        other = f"n - {more}" if more >= 0 else f"n + {-more}"
        for i in range(k + 1):
            a, size = _segment(other, k, i)
            for moved in range(max(-i, more - (k - i)), min(i, more + (k - i)) + 1):
                inside = f"{given} AND {other} >= {max(least, k + 1)} AND {a} + {moved} >= 0 AND {a} + {moved} + {size} <= n"
                out.append(_key(inside, kind, other, i, text, f"({a} + {moved})", size))
    return out


#: Size of the two segments, least and most length of shortened texts that may hold one edit.
CUTS = ((4, TWO, 11), (6, 12, 15), (8, 16, None))


def short_keys(text: str, cut: str, kind: str) -> list[str]:
    """The keys of a text by which it meets longer ones that begin like it; whole up to 7 letters, or by two segments at its begin."""
    out = [_key(f"{cut} AND n BETWEEN {LEAST_CUT} AND {TWO - 1}", f"{kind}c", "n", 0, text, 0, "n")]
    for size, least, most in CUTS:
        fits = f"{cut} AND n >= {least}" + (f" AND n <= {most}" if most else "")
        out += [_key(fits, f"{kind}c{size}", size, i, text, i * size, size) for i in range(2)]
    for size, after in zip(BEGINS, [*BEGINS[1:], None], strict=True):
        out.append(_key(f"NOT {cut} AND n >= {size}" + (f" AND n < {after}" if after else ""), f"{kind}b", size, 0, text, 0, size))
    return out


def beginning_keys(text: str, kind: str, given: str) -> list[str]:
    """The keys of a text by which shortened ones find it: its begins, and its second segments moved by one edit at most."""
    out = [_key(f"{given} AND n > {size}", f"{kind}c", size, 0, text, 0, size) for size in range(LEAST_CUT, TWO)]
    for size, _, _ in CUTS:
        out.append(_key(f"{given} AND n >= {size}", f"{kind}c{size}", size, 0, text, 0, size))
        out += [_key(f"{given} AND n >= {2 * size + moved}", f"{kind}c{size}", size, 1, text, size + moved, size) for moved in (-1, 0, 1)]
    return out + [_key(f"{given} AND n >= {size + 2}", f"{kind}b", size, 0, text, 0, size) for size in BEGINS]


def query_keys(stage: int) -> list[str]:
    """The keys of the columns text and cut."""
    if stage == 1:
        return [*short_keys("text", "cut", "k"), *segment_keys("text", 1, "k1", f"NOT cut AND n >= {ONE}")]
    two, three = f"NOT cut AND n >= {TWO} AND n < {THREE}", f"NOT cut AND n >= {THREE}"
    known = [*substring_keys("text", 2, "k2", two), *substring_keys("text", 3, "k3", three)]
    others = [*substring_keys("text", 1, "o1", f"NOT cut AND n >= {ONE} AND n < {TWO}"), *substring_keys("text", 2, "o2", f"NOT cut AND n >= {TWO}")]
    return [*short_keys("text", "cut", "o"), *known, *others]


def reference_keys(stage: int) -> list[str]:
    """The keys of the columns reference and known."""
    if stage == 1:
        return [*beginning_keys("reference", "k", "known"), *substring_keys("reference", 1, "k1", "known", least=ONE)]
    own = [*segment_keys("reference", 2, "k2", "known"), *segment_keys("reference", 3, "k3", "known")]
    return [*own, *beginning_keys("reference", "o", "NOT known"), *segment_keys("reference", 1, "o1", "NOT known"), *segment_keys("reference", 2, "o2", "NOT known")]


def all_keys(keys: list[str]) -> str:
    return f"array_distinct(array_compact(array({', '.join(keys)})))"


def _keyed(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    return df.withColumn("n", F.length(text)).withColumn("key", F.explode(F.expr(all_keys(keys)))).drop("n")


def _distance() -> Column:
    """Edits between text and reference, of the shortened text to any beginning; null if beyond the bound."""
    length = F.length("text")
    bound = F.when(length >= THREE, 3).when(length >= TWO, 2).when(length >= ONE, 1).otherwise(0)
    inside = F.when(F.length("reference") <= length, -1).when(length >= TWO, 1).otherwise(0)
    begins = [F.levenshtein("text", F.substring(F.col("reference"), F.lit(1), length + d), 1) for d in (-1, 0, 1)]
    best = F.array_min(F.filter(F.array(*begins), lambda d: d >= 0))
    whole = F.levenshtein("text", "reference", 3)
    # The sign that a text was shortened may be lost: an exact begin ranks between one edit and two.
    begin = F.when((length >= TWO) & (F.length("reference") >= length + 2) & F.startswith(F.col("reference"), F.col("text")), F.lit(1.5))
    near = F.when((whole >= 0) & (whole <= bound), whole.cast("double"))
    return F.when(F.col("cut"), F.when(best <= inside, best.cast("double"))).otherwise(F.least(near, begin))


def link_spellings(texts: DataFrame) -> DataFrame:
    """(text, cut, canonical, is_known) of every text.

    texts: text, cut (whether it was shortened), known (whether it is right for certain), weight (its number of
    rows); one row for each text and cut. A known text stands for itself. Another goes to the nearest text that is
    known, or else to a nearby one of greater weight (ties by text), or stays what it is. Chains are followed to
    their end. Texts of any length take part; those too short for an edit stand for themselves, empty ones too. Null
    texts are left out.
    """
    texts = texts.filter(F.col("text").isNotNull()).groupBy("text", "cut").agg(F.max("known").alias("known"), F.sum("weight").alias("weight"))
    texts = cut_lineage(texts)
    whole = texts.filter(~F.col("cut")).withColumnRenamed("text", "_t").select(F.col("_t").alias("text"), "known", "weight")
    queries = texts.filter(~(F.col("known") & ~F.col("cut")))
    greater = F.struct("reference_weight", "reference") > F.struct(F.col("weight").alias("reference_weight"), F.col("text").alias("reference"))
    order = F.struct((~F.col("known")).alias("u"), "d", (-F.col("reference_weight")).alias("w"), "reference")
    references = whole.select(F.col("text").alias("reference"), "known", F.col("weight").alias("reference_weight"))
    found = None
    # What lies within the bound of the first stage is found there for certain; the second looks farther but for fewer texts.
    for stage, settled in ((1, 1.5), (2, 3.0)):
        looked = _keyed(queries.select("text", "cut", "weight"), "text", query_keys(stage))
        index = _keyed(references if stage == 2 else references.filter("known"), "reference", reference_keys(stage))
        # The optimizer can't know how many keys a text has: neither side may be broadcast.
        met = looked.join(index.hint("merge"), "key").filter((F.col("text") != F.col("reference")) | F.col("cut"))
        # Verified where they meet: only near texts are shuffled on. The minimum below takes repeated meetings for one.
        near = met.withColumn("d", _distance()).filter(F.col("d") <= settled)
        near = near.filter(F.col("known") | (F.col("d") <= 2) & (greater | F.col("cut")))
        best = cut_lineage(near.groupBy("text", "cut").agg(F.min_by(F.struct("reference", "known"), order).alias("b")))
        found = best if found is None else found.unionByName(best)
        if stage == 1:
            queries = queries.join(best.select("text", "cut"), ["text", "cut"], "left_anti")
    linked = texts.join(found, ["text", "cut"], "left").select("text", "cut", F.coalesce("b.reference", "text").alias("canonical"), (F.coalesce(F.col("b.known"), F.lit(False)) | (F.col("known") & ~F.col("cut"))).alias("is_known"))
    linked = cut_lineage(linked)
    for _ in range(ROUNDS):  # ends when nothing changes; each round halves the chains
        to = linked.filter(~F.col("cut")).select(F.col("text").alias("canonical"), F.col("canonical").alias("_next"), F.col("is_known").alias("_known"))
        stepped = linked.join(to, "canonical", "left").select("text", "cut", F.coalesce("_next", "canonical").alias("canonical"), (F.col("is_known") | F.coalesce("_known", F.lit(False))).alias("is_known"), (F.col("_next").isNotNull() & (F.col("_next") != F.col("canonical"))).alias("_moved"))
        stepped = cut_lineage(stepped)
        moved = stepped.filter("_moved").limit(1).count()
        linked = stepped.drop("_moved")
        if not moved:
            return linked
    raise RuntimeError(f"chains of spellings did not end within {ROUNDS} rounds")
