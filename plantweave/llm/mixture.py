"""Mixing sources to target weights by capped water-filling.

Sources that can't reach their share even when every document is used as often as allowed are clamped there, and
what they lack goes to the others in proportion to their weights, until no source exceeds its limit. Each
remaining source then repeats all its documents a whole number of times, and a seeded sample of them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import token_count

#: Hash buckets a source, and of the bucket that holds the border; only the last one is sorted.
BUCKETS = 4096


def water_fill(targets: dict[str, tuple[float, int]], sizes: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens of each source. targets: share and most uses; sizes: tokens of one use.

    total: tokens wanted. None: as many as can be had while no source that has any text is clamped, so that those
    sources keep their shares to each other exactly. Sources without text are clamped at 0.
    """
    limit = {s: float(sizes.get(s, 0)) * most for s, (_, most) in targets.items()}
    share = {s: w for s, (w, _) in targets.items()}
    free = {s for s in targets if limit[s] > 0 and share[s] > 0}
    weight = sum(share[s] for s in free)
    if total is None:
        total = min((limit[s] / (share[s] / weight) for s in free), default=0.0)
    given, left = dict.fromkeys(targets, 0.0), float(total)
    while free:
        weight = sum(share[s] for s in free)
        full = {s for s in free if left * share[s] / weight > limit[s] * (1 + 1e-12)}
        if not full:
            given |= {s: min(limit[s], left * share[s] / weight) for s in free}
            break
        for s in full:
            given[s] = limit[s]
        left -= sum(limit[s] for s in full)
        free -= full
    return given


def _draw(seed: int, key: str) -> Column:
    """A number from 0 to 2^62 - 1 that depends on the seed and the key only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col(key)), 2)


def _border(buckets: dict[int, int], rest: float) -> tuple[int, float]:
    """(the bucket in which rest tokens are reached, what is left of them there); BUCKETS if they never are."""
    before = 0
    for k in sorted(buckets):
        if before + buckets[k] > rest:
            return k, float(rest - before)
        before += buckets[k]
    return BUCKETS, float(rest - before)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, path: str | None = None, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(documents used, shares).

    documents: doc_id, text, source. targets: source, target_share, max_repeats; one row a source.
    First result: (doc_id, source, n_tokens, uses), a row for each document that is used at all. Second: (source,
    target_share, max_repeats, available_tokens, tokens, actual_share, epochs), a row for each target, with the
    tokens really taken; actual_share is 0 if nothing is taken at all. Documents of null, unknown or untargeted
    sources and those without a token are never used. Copies are documents like others. A null target_share
    counts as 0, a null max_repeats as 1. total: tokens wanted; None: stretch times the most that can be had without
    clamping any source that has text, so that a stretch above 1 clamps scarce sources and shares their rest out. Whole
    tables go in; the driver holds one row a target and two lots of buckets a source.
    """
    goals = {r.source: (float(r.target_share or 0.0), int(1 if r.max_repeats is None else r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").collect() if r.source is not None}
    wanted = documents.filter(F.col("source").isin([*goals]))
    sized = wanted.select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens")).filter(F.col("n_tokens") > 0)
    drawn = _draw(seed, "doc_id")
    sized = cut_lineage(sized.withColumn("_draw", drawn).withColumn("_bucket", F.shiftright("_draw", 50).cast("int")))
    buckets: dict[str, dict[int, int]] = {s: {} for s in goals}
    for r in sized.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("n")).collect():
        buckets[r.source][r["_bucket"]] = r.n
    sizes = {s: sum(b.values()) for s, b in buckets.items()}
    if total is None:
        total = stretch * sum(water_fill(goals, sizes).values())
    given = water_fill(goals, sizes, total)

    plan = {}
    for s, (_, most) in goals.items():
        whole, rest = divmod(given[s], sizes[s]) if sizes[s] else (0.0, 0.0)
        if whole >= most:
            whole, rest = float(most), 0.0
        plan[s] = (int(whole), *_border(buckets[s], rest))
    # The border bucket is parted again, so that what has to be sorted is a 16 millionth of a source.
    spark = documents.sparkSession
    bucket = F.col("_bucket")
    edges = {s: k for s, (_, k, _) in plan.items() if k < BUCKETS}
    on_edge = F.lit(False)
    for s, k in edges.items():
        on_edge = on_edge | ((F.col("source") == s) & (bucket == k))
    sized = sized.withColumn("_fine", F.shiftright("_draw", 38).cast("int") % BUCKETS)
    fine: dict[str, dict[int, int]] = {s: {} for s in goals}
    for r in sized.filter(on_edge).groupBy("source", "_fine").agg(F.sum("n_tokens").alias("n")).collect() if edges else []:
        fine[r.source][r["_fine"]] = r.n
    rows = [(s, *goals[s], sizes[s], whole, k, *_border(fine[s], rest)) for s, (whole, k, rest) in plan.items()]
    # One row a target.
    plans = F.broadcast(spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, _whole int, _border int, _fine_border int, _rest double"))

    joined = sized.join(plans, "source")
    before = (bucket < F.col("_border")) | (bucket == F.col("_border")) & (F.col("_fine") < F.col("_fine_border"))
    last = (bucket == F.col("_border")) & (F.col("_fine") == F.col("_fine_border"))
    sure = joined.filter(~last).withColumn("_more", before.cast("int"))
    # In the last bucket documents are taken in the order of their draws while half of the next one still fits.
    order = Window.partitionBy("source").orderBy("_draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.filter(last).withColumn("_more", (F.sum("n_tokens").over(order) - F.col("n_tokens") / 2 <= F.col("_rest")).cast("int"))
    chosen = sure.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("_whole") + F.col("_more")).alias("uses")).filter(F.col("uses") > 0)

    taken = chosen.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("tokens"))
    shares = plans.select("source", "target_share", "max_repeats", "available_tokens").join(taken, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    shares = shares.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0))).withColumn("epochs", F.coalesce(F.col("tokens") / F.nullif(F.col("available_tokens"), F.lit(0)), F.lit(0.0)))
    return chosen, shares
