"""Delimited files: exports with byte order marks, other encodings, lines before the header, and absent files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import decimal_comma, plain_name
from ..operators.entries import united


def read_export(spark: SparkSession, *paths: str, sep: str = ";", distinct: bool = False) -> DataFrame:
    """Event exports as text columns: UTF-8 with or without a mark, header names stripped and in lower case.

    Several paths are united, missing columns null. distinct: rows that repeat within one path are dropped.
    """
    parts = [_named(spark.read.csv(p, sep=sep, header=True, encoding="UTF-8", quote='"', escape='"', inferSchema=False)) for p in paths]
    return united(*parts, distinct=distinct)


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file with a header, all columns text."""
    return spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False, multiLine=True)


def read_after_lines(spark: SparkSession, path: str, skip: int = 9, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A file whose header comes after some lines of other text, in one-byte encoding; all columns text.

    The driver reads the lines before the header, blank ones too, and the header; the rest is read in splits. A row that
    equals one of the first lines is kept as often as it occurs below the header.
    """
    first = _first_lines(spark, path, skip + 1, encoding)
    if len(first) <= skip:
        return spark.createDataFrame([], StructType([StructField("empty", StringType())]))
    raw = spark.read.option("encoding", encoding).csv(path, sep="\x01", header=False, inferSchema=False, quote="", comment="").toDF("line")
    names = [c.strip().strip('"') for c in first[skip].split(sep)]
    schema = ", ".join(f"`{c}` string" for c in names)
    above = F.col("line").isin([x for x in first if x])
    # At most as many distinct lines as there are above the first row.
    often = Counter({r.line: r["count"] for r in raw.filter(above).groupBy("line").count().collect()}) - Counter(first)
    rows = raw.filter(~above)
    if often:
        again = spark.createDataFrame([*often.items()], "line string, n long")
        rows = rows.unionByName(again.select("line", F.explode(F.sequence(F.lit(1), F.col("n")))).select("line"))
    return rows.select(F.from_csv("line", schema, {"sep": sep}).alias("row")).select("row.*")


def _first_lines(spark: SparkSession, path: str, n: int, encoding: str) -> list[str]:
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(there).isDirectory():  # a table of one file
        there = next(f.getPath() for f in fs.listStatus(there) if not f.getPath().getName().startswith(("_", ".")))
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(there), encoding))
    try:
        lines = (reader.readLine() for _ in range(n))
        return [x for x in lines if x is not None]
    finally:
        reader.close()


def registry_lookup(raw: DataFrame, kinds: Sequence[str] = ("Einzelanlage", "stillgelegte Anlagen")) -> DataFrame:
    """Registry rows of the given kinds with a normalised name and the net power as a number."""
    kept = raw.filter(F.col("`Datensatztyp*`").isin([*kinds]))
    return kept.select(
        F.col("EinheitMastrNummer").alias("mastr_id"), F.col("Anzeigename").alias("anzeigename"), plain_name(F.col("Anzeigename"), any_case=False, underscores=False).alias("norm_name"),
        F.col("Energietraeger").alias("energietraeger"), decimal_comma(F.col("Nettonennleistung_MW")).alias("nettonennleistung_mw"), F.col("Postleitzahl").alias("postleitzahl"), F.col("Ort").alias("ort"),
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of the schema where it doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def sample_run(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows for a smoke run; all where limit is None."""
    return df if limit is None else df.limit(limit)
