"""Encoding of texts by a public byte-level BPE: overlapping chunks, stitched where their boundaries agree.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own. A scan that starts inside
a pre-token may begin with wrong boundaries, but from the first boundary that it shares with the scan of the chunk
before, both are the same, as a pre-token depends only on what follows its start. Texts are cut there, but not
after white space, whose end depends on what follows, and the pieces encoded independently. Texts whose chunks share no boundary
in an overlap are cut again with chunks and overlaps eight times as wide. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage

#: Characters of a chunk, and of the overlap on either side of its end.
CHUNK, OVERLAP = 20_000, 500
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> str:
    """The path of a vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201 - tiktoken is imported late
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def _encode(path: str):  # noqa: ANN202
    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(path)
        for texts in batches:
            yield pd.Series([coder.encode_ordinary(x) if isinstance(x, str) else [] for x in texts], dtype=object)

    return encode


def _boundaries():  # noqa: ANN202
    @pandas_udf("array<int>")
    def boundaries(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        """Starts of pre-tokens (in characters from the text's begin) that lie in the chunk's two overlaps."""
        for texts, starts, lows, highs in batches:
            out = []
            for text, start, low, high in zip(texts, starts, lows, highs, strict=True):
                at = [m.start() + start for m in _pattern().finditer(text)]
                # A pattern looks at most three characters ahead, so only starts near the cut end may be wrong.
                sure = start + len(text) - 8
                # A piece that ends in white space would be split otherwise than in its text; none may end there.
                out.append([x for x in at[1:] if x <= sure and (x < low or x >= high) and not text[x - start - 1].isspace()])
            yield pd.Series(out, dtype=object)

    return boundaries


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row: the ids of its whole text; the empty list for an empty or null text.

    key must be unique. Strings that look like special tokens are ordinary text. Texts of up to chunk characters are
    encoded in one go; longer ones in chunks that are spread over the cluster. Where neighbouring chunks of a text share
    no boundary, as in one endless word, the text is cut again, wider.
    """
    path = path or vocabulary()
    encode = _encode(path)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    length = F.coalesce(F.length("_text"), F.lit(0))
    short = rows.filter(length <= chunk).select(F.col("_key").alias(key), encode("_text").alias("ids"))

    # Long texts are few; they are written once, and where there are none the texts are read only once more.
    long = cut_lineage(rows.filter(length > chunk))
    if not long.limit(1).count():
        return short
    n = F.ceil(F.length("_text") / chunk).cast("int")
    # Chunk i owns [i * chunk, (i + 1) * chunk) and carries an overlap on both sides.
    pieces = long.select("_key", F.length("_text").alias("_all"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_text"), F.greatest(F.lit(1), i * chunk - overlap + 1), F.when(i == 0, chunk + overlap).otherwise(chunk + 2 * overlap)))).alias("_i", "_part"))
    pieces = pieces.repartition("_key", "_i").withColumn("_start", F.greatest(F.lit(0), F.col("_i") * chunk - overlap))
    low, high = F.col("_i") * chunk + overlap, (F.col("_i") + 1) * chunk - overlap
    scanned = pieces.withColumn("_at", _boundaries()(F.col("_part"), F.col("_start"), low, high))
    order = Window.partitionBy("_key").orderBy("_i")
    shared = F.array_min(F.array_intersect(F.lag("_at").over(order), F.filter(F.col("_at"), lambda x: x < F.col("_i") * chunk + overlap)))
    cuts = scanned.select("_key", "_i", "_at").withColumn("_from", F.when(F.col("_i") == 0, F.lit(0)).otherwise(shared)).select("_key", "_i", "_from")
    cuts = cuts.withColumn("_to", F.lead("_from").over(order)).withColumn("_bad", F.max((F.col("_from").isNull()).cast("int")).over(Window.partitionBy("_key")))
    bad = cuts.filter((F.col("_bad") == 1) & (F.col("_i") == 0)).select("_key")
    whole = cut_lineage(long.join(bad, "_key", "left_semi"))
    wider = encode_texts(whole, "_key", "_text", path, 8 * chunk, 8 * overlap).withColumnRenamed("_key", key) if whole.limit(1).count() else None
    good = pieces.join(cuts.filter(F.col("_bad") == 0), ["_key", "_i"])
    piece = F.substring(F.col("_part"), F.col("_from") - F.col("_start") + 1, F.coalesce(F.col("_to"), F.col("_all")) - F.col("_from"))
    coded = good.select("_key", "_i", piece.alias("_piece")).select("_key", F.struct("_i", encode("_piece").alias("ids")).alias("_p"))
    stitched = coded.groupBy("_key").agg(F.array_sort(F.collect_list("_p")).alias("_ps")).select(F.col("_key").alias(key), F.flatten(F.col("_ps.ids")).alias("ids"))
    out = short.unionByName(stitched)
    return out if wider is None else out.unionByName(wider)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; 0 for null."""
    path = path or vocabulary()

    @pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(path)
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(x)) if isinstance(x, str) else 0 for x in texts], dtype="int32")

    # Else a filter on the number would be pushed below the projection and encode everything twice.
    return count.asNondeterministic()(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of a list of ids, concatenated; of null, null. UTF-8 if the ids are those of a whole text."""
    path = path or vocabulary()

    @pandas_udf("binary")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(path)
        for lists in batches:
            yield pd.Series([None if x is None else coder.decode_bytes([int(i) for i in x]) for x in lists], dtype=object)

    return join(ids)
