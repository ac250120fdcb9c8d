"""Matching records of two sources without a common key.

Attributes are encoded as bit vectors of their q-grams. Vectors of places that differ in at most RADIUS bits are
found exactly by multi-index hashing: of CHUNKS chunks at least CHUNKS - RADIUS are equal, so some set of that many
chunks is, and each such set is a key of an equality join. Records of near places are then joined on what must be
equal. Fields are compared in levels of their Dice coefficient or relative difference. How often a level comes up by
chance is counted over all records; how often in a match, and how many matches there are, is learned by expectation
maximisation. Their log ratios are the fields' weights. What they say without the capacity is calibrated by isotonic
regression on how often the capacities, held out, agree.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, usable
from ..session import cut_lineage, spread
from .names import ENERGY, NO_WORDS, Words, parse

CHUNKS, WIDTH, RADIUS = 9, 28, 6
#: Largest relative difference of two capacities of one plant, and the ratio between capacity classes.
TOLERANCE, CLASS = 0.06, 1.07
#: Relative differences up to which a capacity has the levels 4, 3 and 2; beyond it has 1.
STEPS = (0.02, TOLERANCE, 0.2)
#: Least probabilities of the levels of confidence.
LEVELS = (("high", 0.9), ("medium", 0.6), ("low", 0.1))
_CHUNK = [f"v{i}" for i in range(CHUNKS)]


def bits(text: str, q: int = 2) -> list[int]:
    """The chunks of the bit vector of a text's q-grams, with its ends marked."""
    out = [0] * CHUNKS
    padded = f"^{text}$"
    for i in range(len(padded) - q + 1):
        at = zlib.crc32(padded[i : i + q].encode()) % (CHUNKS * WIDTH)
        out[at // WIDTH] |= 1 << at % WIDTH
    return out


def _vectors(texts: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(t, *bits(t)) for t in pdf[name]], columns=[name, *_CHUNK])

    return spread(texts).mapInPandas(run, f"{name} string, " + ", ".join(f"{c} int" for c in _CHUNK))


def close_texts(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(l, r, dice) of all texts l of left (l) and r of right (r), distinct, whose vectors differ in at most radius bits."""
    sets = [*itertools.combinations(range(CHUNKS), CHUNKS - radius)]

    def keyed(df: DataFrame, name: str, prefix: str) -> DataFrame:
        v = _vectors(df, name).select(name, *[F.col(c).alias(f"{prefix}{c}") for c in _CHUNK])
        keys = F.array(*[F.xxhash64(F.lit(n), *[F.col(f"{prefix}v{i}") for i in s]) for n, s in enumerate(sets)])
        return v.withColumn("key", F.explode(keys))

    # The optimizer can't know how many keys a text has: neither side may be broadcast.
    pairs = keyed(left, "l", "a").join(keyed(right, "r", "b").hint("merge"), "key")
    differ = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _CHUNK[1:]), F.bit_count(F.col("av0").bitwiseXOR(F.col("bv0"))))
    both = sum((F.bit_count(F.col(f"a{c}").bitwiseAND(F.col(f"b{c}"))) for c in _CHUNK[1:]), F.bit_count(F.col("av0").bitwiseAND(F.col("bv0"))))
    near = pairs.withColumn("_d", differ).filter(F.col("_d") <= radius)
    return near.select("l", "r", (2 * both / (2 * both + F.col("_d"))).alias("dice")).dropDuplicates(["l", "r"])


def registry_records(registry: DataFrame, words: Words = NO_WORDS) -> DataFrame:
    """Registry rows taken apart: mastr_id, place, town, types, block, direction, sections, net, generic.

    types: what its name or else its energy tells; all types if neither does. generic: its name holds no place.
    """
    everything = sorted({t for ts in ENERGY.values() for t in ts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, name, energy, net, town in pdf.itertuples(index=False, name=None):
                parts = parse(name, words)
                p = parts[0] if len(parts) == 1 else None
                towns = parse((town or "").split(",")[0], words)
                told = sorted(ENERGY.get((energy or "").strip().lower(), ())) or everything
                generic = p is None or not p.place
                types = ["C"] if p is not None and p.cluster else [p.type] if p is not None and p.type else told
                if len(parts) > 1:
                    continue
                rows.append((key, p.place if p else "", towns[0].place if towns else "", types, "" if generic or p is None else p.block, p.direction if p else "", p.sections if p else "", net if net and net > 0 else None, generic))
            yield pd.DataFrame(rows, columns=["mastr_id", "place", "town", "types", "block", "direction", "sections", "net", "generic"])

    columns = ["mastr_id", "anzeigename", "energietraeger", "nettonennleistung_mw", "ort"]
    return spread(registry.select(*columns)).mapInPandas(run, "mastr_id string, place string, town string, types array<string>, block string, direction string, sections string, net double, generic boolean")


def _class(c: Column) -> Column:
    return F.floor(F.log(c) / math.log(CLASS)).cast("int")


def _candidates(records: DataFrame, near: DataFrame) -> DataFrame:
    """(record columns, l, name_dice, town_dice): the entities' places l that fit each record best.

    The place in its name counts, and where it has none, its town. Ties are all kept. All rows of a record come
    together once; the aggregate and the window over them share that shuffle.
    """
    role = F.explode(F.array(F.struct(F.lit(True).alias("name"), F.col("place").alias("r")), F.struct(F.lit(False).alias("name"), F.col("town").alias("r"))))
    asked = records.select("*", role.alias("_role")).select(*records.columns, "_role.name", "_role.r").filter("r <> ''")
    met = asked.join(near.hint("merge"), "r").repartition("mastr_id")
    carried = [c for c in records.columns if c != "mastr_id"]
    dice = [F.max(F.when(F.col("name") == told, F.col("dice"))).alias(c) for told, c in ((True, "name_dice"), (False, "town_dice"))]
    both = met.groupBy("mastr_id", "l").agg(*[F.first(c).alias(c) for c in carried], *dice)
    fit = F.when(F.col("generic"), F.col("town_dice")).otherwise(F.col("name_dice") + 0.5 * F.coalesce("town_dice", F.lit(0.0)))
    ranked = both.withColumn("fit", fit).filter("fit IS NOT NULL").withColumn("best", F.max("fit").over(Window.partitionBy("mastr_id")))
    return ranked.filter(F.col("fit") >= F.col("best") - 1e-9).drop("fit", "best")


def _options(candidates: DataFrame, side: DataFrame) -> DataFrame:
    """(mastr_id, entity, kind, n, and what is compared) of records and entities that may be one plant.

    kind: named (equal type, block, direction and sections), sized (a record without a place, a similar capacity), left
    (such a record without a capacity of its own or of theirs to go by; n tells how many entities it may mean).
    """
    typed = candidates.withColumn("type", F.explode("types"))
    shown = ["mastr_id", "l", "type", "name_dice", "town_dice", "net"]
    told = ["block", "direction", "sections"]
    named = typed.filter("NOT generic").select(*shown, *told).join(side.select("entity", "capacity", "l", "type", *told).hint("merge"), ["l", "type", *told])
    named = named.select(*shown, "entity", "capacity", F.lit("named").alias("kind"), F.lit(1).cast("long").alias("n"))
    blank = typed.filter("generic").select(*shown, F.size("types").alias("n_types"))
    # Capacities within TOLERANCE lie in the same class or in neighbouring ones.
    classed = side.filter("capacity > 0").select("entity", "capacity", "l", "type", _class(F.col("capacity")).alias("class"))
    asked = blank.filter("net > 0").withColumn("class", F.explode(F.array(*[_class(F.col("net")) + i for i in (-1, 0, 1)])))
    sized = asked.join(classed.hint("merge"), ["l", "type", "class"])
    sized = sized.select(*shown, "entity", "capacity", F.lit("sized").alias("kind"), F.lit(1).cast("long").alias("n"))
    unknown = F.col("capacity").isNull()
    few = side.groupBy("l", "type").agg(F.count(F.lit(1)).alias("n_all"), F.min("entity").alias("any"), F.count_if(unknown).alias("n_unknown"), F.min(F.when(unknown, F.col("entity"))).alias("unknown"))
    has_net = F.col("net").isNotNull()
    left = blank.filter("n_types <= 2").join(few.hint("merge"), ["l", "type"]).withColumn("n", F.when(has_net, F.col("n_unknown")).otherwise(F.col("n_all")))
    left = left.filter("n > 0").select(*shown, F.when(has_net, F.col("unknown")).otherwise(F.col("any")).alias("entity"), F.lit(None).cast("double").alias("capacity"), F.lit("left").alias("kind"), "n")
    return named.unionByName(sized).unionByName(left)


def _levels(options: DataFrame) -> DataFrame:
    """options with levels of comparison, 0 for what isn't known: c_name and c_town (2 equal, 1 near), c_capacity (4 to 1)."""
    near = lambda c: F.when(F.col(c).isNull(), 0).when(F.col(c) >= 1.0, 2).otherwise(1)
    gap = F.abs(F.log(F.col("net") / F.col("capacity")))
    level = F.lit(1)
    for n, most in zip((2, 3, 4), reversed(STEPS), strict=True):
        level = F.when(F.col("gap") <= math.log1p(most), n).otherwise(level)
    return options.withColumn("gap", gap).withColumn("c_name", near("name_dice")).withColumn("c_town", near("town_dice")).withColumn("c_capacity", F.when(F.col("gap").isNull(), 0).otherwise(level))


FIELDS = ("c_name", "c_town", "c_capacity")


def learned_ratios(patterns: np.ndarray, counts: np.ndarray, by_chance: np.ndarray, fixed: np.ndarray, pairs: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(share of matches among all pairs, log ratios by field and level) by expectation maximisation.

    patterns: rows of levels, 0 for what isn't known and tells nothing. by_chance: the probability of each field's
    levels in pairs that don't match; these stay, while those in matches are learned. fixed: log ratio of all that
    agrees in every pair of a pattern. pairs: number of all pairs; those in no pattern don't match.
    """
    share, ratios = min(0.05, counts.sum() / 2 / pairs), np.zeros(by_chance.shape)
    ratios[:, 1:] = 2.0 * np.arange(by_chance.shape[1] - 1) - 2.0  # at first, closer is likelier
    for _ in range(rounds):
        logit = math.log(share / (1 - share)) + fixed + sum(ratios[f, patterns[:, f]] for f in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        before = share
        share = float(np.clip((post * counts).sum() / pairs, 1e-12, 0.5))
        for f in range(patterns.shape[1]):
            m = np.bincount(patterns[:, f], weights=post * counts, minlength=by_chance.shape[1])[1:]
            possible = by_chance[f, 1:] > 0
            m = np.where(possible, m + 0.5, 0)
            ratios[f, 1:] = np.where(possible, np.log(np.maximum(m / m.sum(), 1e-12)) - np.log(np.maximum(by_chance[f, 1:], 1e-12)), 0.0)
        if abs(share - before) < 1e-9 * share:
            break
    return share, ratios


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression: the nearest ascending values."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.array([])


def calibrated(logits: np.ndarray, held_out: np.ndarray, agreed: np.ndarray, chance: float) -> np.ndarray:
    """Logits by isotonic regression on a field that the given logits don't know.

    held_out and agreed: pairs with and with equal values of that field, for each logit. In matches it agrees as often
    as at the largest logit, else by chance; the share of matches at a logit follows. Without pairs a logit stays.
    """
    out, has = logits.copy(), held_out > 0
    if has.sum() < 2:
        return out
    order = np.flatnonzero(has)[np.argsort(logits[has], kind="stable")]
    rate = pooled(agreed[order] / held_out[order], held_out[order])
    top = max(rate[-1], chance + 1e-6)
    # A share that rests on few pairs is drawn to the model's by two pairs of its kind.
    model = 1 / (1 + np.exp(-np.clip(logits[order], -30, 30)))
    share = np.clip((rate - chance) / (top - chance), 0.0, 1.0)
    share = pooled((share * held_out[order] + 2 * model) / (held_out[order] + 2), held_out[order])
    share = np.clip(share, 1e-6, 1 - 1e-6)
    out[order] = np.log(share / (1 - share))
    return out


def confidence(probability: Column) -> Column:
    """high, medium, low or none, by LEVELS."""
    level = F.lit("none")
    for name, least in reversed(LEVELS):
        level = F.when(probability >= least, name).otherwise(level)
    return level


def _model(entities: DataFrame, levels: DataFrame, n_near: int, n_places: int, n_records: int) -> DataFrame:
    """(kind, the levels, score, probability) of every pattern of comparison; a few dozen rows."""
    value = lambda f, c: F.struct(F.lit(f).alias("field"), c.cast("string").alias("value"))
    fields = ["place", "type", "block", "direction", "sections"]
    held = F.array(*[value(f, F.col(f)) for f in fields], value("capacity", _class(F.when(F.col("capacity") > 0, F.col("capacity")))))
    counts = entities.select(F.explode(held).alias("h")).select("h.*").filter("value IS NOT NULL").groupBy("field", "value").count()
    told = {r.field: r for r in counts.groupBy("field").agg(F.sum(F.pow("count", F.lit(2.0))).alias("squares"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    chance = {f: min(0.999, max(r.squares / r.n**2, 1e-9)) for f, r in told.items()}
    same = chance.get("capacity", 0.1)
    near = min(0.5, max(n_near / (told["place"].distinct * max(n_places, 1)), 1e-9))
    # By chance, differences are as frequent as classes of capacity are wide.
    bins = [min(0.9, 2 * math.log1p(x) / math.log(CLASS) * same) for x in STEPS]
    u = np.zeros((3, 5))
    u[0, 1:3] = u[1, 1:3] = near, chance["place"]
    u[2, 1:5] = max(1e-3, 1 - bins[2]), max(1e-6, bins[2] - bins[1]), max(1e-6, bins[1] - bins[0]), bins[0]
    rows = levels.groupBy("kind", *FIELDS).agg(F.count(F.lit(1)).alias("count")).orderBy("kind", *FIELDS).collect()
    spark = entities.sparkSession
    schema = "kind string, c_name int, c_town int, c_capacity int, score double, probability double"
    if not rows:
        return spark.createDataFrame([], schema)
    patterns, n = np.array([[r[f] for f in FIELDS] for r in rows]), np.array([float(r["count"]) for r in rows])
    agree = -math.log(chance["type"])
    labels = agree - sum(math.log(chance[f]) for f in ("block", "direction", "sections"))
    fixed = np.array([labels if r.kind == "named" else agree for r in rows])
    share, ratios = learned_ratios(patterns, n, u, fixed, float(told["place"].n) * max(n_records, 1))
    prior = math.log(share / (1 - share))
    size = ratios[2, patterns[:, 2]]
    score = fixed + ratios[0, patterns[:, 0]] + ratios[1, patterns[:, 1]]
    named = np.array([r.kind == "named" for r in rows])
    # Pairs of one pattern but for the capacity share a logit without it.
    keys, at = np.unique(np.column_stack([patterns[:, :2], named]), axis=0, return_inverse=True)
    at = at.ravel()
    plain = np.array([prior + score[at == k].mean() for k in range(len(keys))])
    known = named & (patterns[:, 2] > 0)
    held_out = np.bincount(at[known], weights=n[known], minlength=len(keys))
    agreed = np.bincount(at[known & (patterns[:, 2] >= 3)], weights=n[known & (patterns[:, 2] >= 3)], minlength=len(keys))
    logit = calibrated(plain, held_out, agreed, bins[1])[at] + size
    probability = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    data = [(r.kind, *[int(r[f]) for f in FIELDS], float(s), float(p)) for r, s, p in zip(rows, score + size, probability, strict=True)]
    return spark.createDataFrame(data, schema)


def match_entities(entities: DataFrame, registry: DataFrame, words: Words = NO_WORDS) -> DataFrame:
    """(entity, mastr_id, score, probability, confidence) of pairs that may be one plant.

    entities: entity (unique), place, type (C: cluster), block, direction, sections, capacity (null: unknown).
    Specific registry names meet entities of a near place, the same type, block, direction and sections. Names
    without a place meet those of their town and type by capacity: the nearest within TOLERANCE; if there is none, the
    only one of unknown capacity; records without a capacity the only plant of the town and type. words: those of operators
    and grids, which are no places. Bundles have no match. Repeated registry rows each count. Empty inputs give no pair.
    """
    side = cut_lineage(entities.select("entity", F.col("place").alias("l"), "type", "block", "direction", "sections", "capacity").filter("l <> ''"))
    records = cut_lineage(registry_records(registry, words))
    places = cut_lineage(records.select(F.explode(F.array("place", "town")).alias("r")).filter("r <> ''").distinct())
    near = cut_lineage(close_texts(side.select("l").distinct(), places))
    levels = cut_lineage(_levels(_options(cut_lineage(_candidates(records, near)), side)))
    n_near, n_places, n_records = near.filter("dice < 1").count(), places.count(), records.count()
    if not n_records or not side.limit(1).count():
        return levels.select("entity", "mastr_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("probability"), F.lit("none").alias("confidence")).limit(0)
    model = _model(side.withColumnRenamed("l", "place"), levels, n_near, n_places, n_records)

    # Of the options of a record the nearest capacity counts; what is left over only if nothing else fits.
    own = Window.partitionBy("mastr_id")
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    gap = F.coalesce("gap", F.lit(9.0))
    inside = F.coalesce("gap", F.lit(9.0)) <= math.log1p(TOLERANCE)
    judged = levels.withColumn("_named", F.min(of("named", gap)).over(own)).withColumn("_sized", F.min(F.when(inside, of("sized", gap))).over(own)).withColumn("_left", F.sum(of("left", F.col("n"))).over(own))
    named = (F.col("kind") == "named") & (gap <= F.col("_named") + 1e-12)
    sized = (F.col("kind") == "sized") & (gap <= F.col("_sized") + 1e-12)
    left = (F.col("kind") == "left") & F.col("_sized").isNull() & (F.col("_left") == 1)
    kept = judged.filter(named | sized | left)
    # One row a pattern.
    scored = kept.join(F.broadcast(model), ["kind", *FIELDS])
    best = scored.groupBy("mastr_id", "entity").agg(F.max("score").alias("score"), F.max("probability").alias("probability"))
    return best.select("entity", "mastr_id", "score", "probability", confidence(F.col("probability")).alias("confidence"))


def label_reliability(rows: DataFrame, plants: DataFrame, km: float = 25.0) -> dict[str, float]:
    """How often rows of each level of confidence lie within km of the plant that their name tells.

    rows: entity, label (high, medium, low or none; others and null count as unknown), lat, lon. plants: entity, lat, lon.
    Rising from none to high by isotonic regression; a level without located rows has the mean of all, 1 if there are none.
    """
    order = ["none", *[name for name, _ in reversed(LEVELS)]]
    label = F.when(F.col("label").isin(order), F.col("label")).otherwise("unknown")
    swapped = F.col("lat") < F.col("lon")  # rows whose latitude and longitude were exchanged
    lat, lon = F.when(swapped, F.col("lon")).otherwise(F.col("lat")), F.when(swapped, F.col("lat")).otherwise(F.col("lon"))
    at = rows.filter(usable(F.col("lat"), F.col("lon"))).select("entity", label.alias("label"), lat.alias("lat"), lon.alias("lon"))
    there = plants.filter(usable(F.col("lat"), F.col("lon"))).groupBy("entity").agg(F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("p"))
    near = haversine_km(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")) <= km
    # One row a label.
    found = {r.label: (r.agreed + 1, r.n + 2) for r in at.join(there.hint("merge"), "entity").groupBy("label").agg(F.count_if(near).alias("agreed"), F.count(F.lit(1)).alias("n")).collect()}
    told = [x for x in order if x in found]
    rising = pooled(np.array([found[x][0] / found[x][1] for x in told]), np.array([float(found[x][1]) for x in told]))
    mean = sum(a for a, _ in found.values()) / sum(n for _, n in found.values()) if found else 1.0
    return {x: mean for x in [*order, "unknown"]} | dict(zip(told, map(float, rising), strict=True)) | {"unknown": found["unknown"][0] / found["unknown"][1] if "unknown" in found else mean}
