"""Results written: delimited files, appended batches, replaced tables, and the document of the map."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import known_confidence
from ..session import cut_lineage


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of delimited files with headers; arrays are joined by commas. Large results keep their partitions."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't in the table yet, and returns them; a restart repeats nothing."""
    done = _existing(df, path)
    # Written first: read again after the append, it would find its own keys.
    new = cut_lineage(df.join(done.select(key).distinct(), key, "left_anti").select(df.columns))
    new.write.mode("append").parquet(path)
    return new


def _existing(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(df.schema).parquet(path) if there else spark.createDataFrame([], df.schema)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table that df may itself read: written beside it, then put in its place.

    The old table is only moved aside before the new one takes its name, and deleted last: whatever fails, one of them is there.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}-{mark}-new")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = at(f"{path.rstrip('/')}-{mark}-new"), at(f"{path.rstrip('/')}-{mark}-old")
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = fs.exists(at(path)) and fs.rename(at(path), old)
    if not fs.rename(fresh, at(path)):
        if moved:
            fs.rename(old, at(path))
        raise OSError(f"{fresh} could not be renamed to {path}")
    if moved:
        fs.delete(old, True)


def map_document(plants: DataFrame, unmapped: DataFrame, meta: DataFrame, name: str = "MAP_DATA") -> str:
    """The text of a script that declares the map's data.

    plants: name, lat, lon, fueltype, entry_type, matched, confidence, series (a map from day to two numbers); one row a
    plant. unmapped: category, day, mwh. meta: one row. A reporting document for a browser: it holds one row a plant.
    """
    rows = plants.withColumn("confidence", known_confidence(F.col("confidence"))).withColumn("lat", F.round("lat", 5)).withColumn("lon", F.round("lon", 5))
    listed = [json.loads(r[0]) for r in rows.orderBy("name").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    rest: dict[str, dict[str, float]] = {}
    for r in unmapped.orderBy("category", "day").toLocalIterator():
        rest.setdefault(r["category"], {})[str(r["day"])] = r["mwh"]
    told = {k: str(v) if hasattr(v, "isoformat") else v for k, v in meta.first().asDict().items()}
    data = {"meta": {"generated": datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC")} | told, "plants": listed, "unmapped": rest}
    return f"const {name} = {json.dumps(data, ensure_ascii=False, separators=(',', ':'))};\n"
