"""Words of names told by where they stand: operators and grids beside many places, adjectives before many stems.

A place stands beside few other words, however often it is named; the name of an operator stands beside as many places as
the operator has plants. So the words are learned from counts of distinct neighbours, over all names of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .names import Words, unknown_words

#: A word is learned if it has at least so many distinct neighbours, and at least this share of the most that a word has.
COMPANION, ADJECTIVE, SHARE = 3, 2, 0.05
#: More learned words than that would not be words of the kinds that are meant.
MOST = 100_000


def _beside(texts: DataFrame) -> DataFrame:
    """(word, other) of the distinct pairs of unknown words in one piece of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = {(a, b) for t in pdf.text for piece in unknown_words(t) if len(piece) > 1 for a in piece for b in piece if a != b}
            yield pd.DataFrame([*pairs], columns=["word", "other"])

    return spread(texts.select("text")).mapInPandas(run, "word string, other string").distinct()


def _frequent(pairs: DataFrame, least: int) -> frozenset[str]:
    counts = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    limit = counts.agg(F.greatest(F.lit(float(least)), SHARE * F.max("n")).alias("limit"))  # one row
    rows = counts.join(F.broadcast(limit), F.col("n") >= F.col("limit")).select("word").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} words stand beside many others")
    return frozenset(r.word for r in rows)


def learned_words(names: DataFrame, index_names: DataFrame, aliases: DataFrame) -> Words:
    """The companions and adjectives of a corpus.

    names: text, distinct names as they are read. index_names: text, names of the plant index, whose words are places if they
    stand beside few others. aliases: text, nicknames. Empty tables teach nothing; null texts are passed over.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"other": [*{w for t in pdf.text for piece in unknown_words(t) for w in piece}]}, dtype=object)

    known = spread(index_names.select("text").distinct()).mapInPandas(words, "other string").distinct()
    beside = _beside(names).join(known.hint("merge"), "other", "left_semi")
    return Words(_frequent(beside, COMPANION), _frequent(_beside(aliases), ADJECTIVE))
