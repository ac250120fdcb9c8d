"""Session and table access, the checkpoint folder, and the checked broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if the optimizer's estimate of it stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    n = cores or os.cpu_count() or 4
    settings = {
        "spark.master": f"local[{n}]",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName("plantweave")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the cluster's checkpoint folder, which all executors share.

    Only where spark.checkpoint.dir is unset and the master is local, as in tests, a temporary folder of this machine
    is taken. What is written there is of no use after the application.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(context, "_plantweave_folder", None) or tempfile.mkdtemp(prefix="plantweave-")
        if not hasattr(context, "_plantweave_folder"):
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._plantweave_folder = folder
    return f"{folder.rstrip('/')}/plantweave-{context.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder once and read back: it survives lost executors and has no lineage.

    A written table is computed once, while a checkpoint of a Dataset is computed twice, and the optimizer knows its
    true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; nothing is run for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, row_bytes: int | None = None) -> DataFrame:
    """Hints a broadcast if df is below limit; else the join is left to shuffle.

    row_bytes: the rows are counted and taken to have that size each; without it the optimizer's estimate counts.
    """
    size = df.count() * row_bytes if row_bytes else estimated_bytes(df)
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for steps that cost far more than the bytes of their rows tell the planner."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that executors need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_plantweave_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plantweave-")  # read by this driver alone, which serves it to the executors
    archive = Path(folder, "plantweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, str(path.relative_to(here.parent)))
    context.addPyFile(str(archive))
    context._plantweave_shipped = True
