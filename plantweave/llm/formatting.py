"""Records that differ only in formatting: one record each, with its number of copies.

A canonical key holds what formatting can't change. Hot keys are found exactly by partial counts. They are
salted and aggregated in two levels, and their rows meet their representative by a map-side join; all other
keys are small and take one shuffle. The representative is the smallest identifier.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..session import BROADCAST_BYTES, cut_lineage

#: A key with more rows is hot. There are fewer hot keys than rows / HOT_ROWS.
HOT_ROWS, SALTS = 50_000, 64
#: What a hot key is taken to need in memory.
HOT_BYTES = 100

_WORD = regex.compile(r"(?:\p{L}\p{M}*)+|\p{N}+")
_UNSEEN = regex.compile(r"(?:(?![\s\x1c-\x1f])[\p{Cf}\p{Cc}])+")


def words(text: str) -> list[str]:
    """Words and numbers of a text, without case, punctuation and invisible characters, composed, sorted."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _UNSEEN.sub("", text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return sorted(_WORD.findall(text))


def _digest(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """128-bit digest of the set of fields, each the sorted words of its text; a null field is a field of its own."""
    for columns in batches:
        out = []
        for row in zip(*columns, strict=True):
            fields = sorted("\x00" if x is None or x != x else "\x01" + "\x02".join(words(x)) for x in row)
            out.append(hashlib.blake2b("\x03".join(fields).encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pd.Series(out, dtype=object)


def canonical_key(*texts: Column) -> Column:
    """A key that is equal for texts of the same words and numbers, each as often, fields in any order.

    Null differs from a text, also from one without any word. Texts that hold no word are equal to each other.
    """
    return pandas_udf(_digest, BinaryType())(*texts)


def keyed(df: DataFrame, row_id: str, same: list[str], texts: list[str]) -> DataFrame:
    """(row_id, key): the digest of the texts and of the fields that must be equal (null equals null)."""
    exact = F.concat_ws("\x02", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in same]) if same else F.lit("")
    return df.select(F.col(row_id), canonical_key(*[F.col(c) for c in texts]).alias("_texts"), exact.alias("_same")).select(row_id, F.unhex(F.md5(F.concat("_texts", F.encode("_same", "UTF-8")))).alias("_key"))


def representatives(keys: DataFrame, row_id: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """(row_id, keep_id, n_copies) of every row of keys (row_id, _key).

    Ties can't occur, as identifiers are unique; if one is repeated, each of its rows counts. Null identifiers
    never represent. No rows give no rows.
    """
    keys = cut_lineage(keys.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")))
    hot = cut_lineage(keys.groupBy("_key").count().filter(F.col("count") > hot_rows).select("_key"))
    part = Window.partitionBy("_key")
    rest = _with_hot(keys, hot, salts, "left_anti").select(row_id, F.min(row_id).over(part).alias("keep_id"), F.count(F.lit(1)).over(part).alias("n_copies"))
    hot_part = _with_hot(keys, hot, salts, "left_semi")
    levels = hot_part.groupBy("_key", "_salt").agg(F.min(row_id).alias("_min"), F.count(F.lit(1)).alias("_n"))
    kept = cut_lineage(levels.groupBy("_key").agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("n_copies")))
    return rest.unionByName(_with_hot(hot_part, kept, salts, "inner").select(row_id, "keep_id", "n_copies"))


def _with_hot(rows: DataFrame, hot: DataFrame, salts: int, how: str) -> DataFrame:
    """rows (_key, _salt) joined with hot (_key, written): broadcast where it is small, else on key and salt with a copy of hot for each salt."""
    if hot.count() * HOT_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hot), "_key", how)
    copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies, ["_key", "_salt"], how)


def copies(df: DataFrame, row_id: str, same: list[str], texts: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keep_id, copy_id): each row that is a copy, with the row that stands for it."""
    rows = representatives(keyed(df, row_id, same, texts), row_id, hot_rows)
    return rows.filter(F.col(row_id) != F.col("keep_id")).select("keep_id", F.col(row_id).alias("copy_id"))


def records(df: DataFrame, row_id: str, same: list[str], texts: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keep_id, n_copies): one row a record, with the number of rows that it stands for, itself included."""
    rows = representatives(keyed(df, row_id, same, texts), row_id, hot_rows)
    return rows.filter(F.col(row_id) == F.col("keep_id")).select("keep_id", "n_copies")
