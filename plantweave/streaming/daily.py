"""The daily volumes as a stream: calls arrive as files, late ones until the watermark, and days are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.volumes import volumes


def read_calls(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_stream(calls: DataFrame, late: str = "60 days") -> DataFrame:
    """window, name, inc, dec of a stream of calls; a call later than the watermark of its day is dropped."""
    rows = volumes(calls).withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day"), "name").agg(F.sum("inc").alias("inc"), F.sum("dec").alias("dec"), F.count(F.lit(1)).alias("n_calls"))


def first_reports(calls: DataFrame, late: str = "60 days") -> DataFrame:
    """Calls of a stream without those that repeat an earlier one in all fields but the key, within the watermark."""
    fields = [c for c in calls.columns if c not in ("row_id", "exported_at")]
    return calls.withWatermark("exported_at", late).dropDuplicatesWithinWatermark(fields)


def upsert_days(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed days under its number; the newest number of a day and name counts on reading."""

    def write(batch: DataFrame, number: int) -> None:
        flat = batch.select(F.to_date("window.start").alias("day"), "name", "inc", "dec", "n_calls").withColumn("batch", F.lit(number))
        flat.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_days(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct("inc", "dec", "n_calls"), "batch").alias("_v")
    return rows.groupBy("day", "name").agg(newest).select("day", "name", "_v.*")
