"""Tables written to the folder that all executors share, to end a lineage."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_RUN, _NEXT = uuid.uuid4().hex[:12], itertools.count()


def shared_root(spark: SparkSession) -> str:
    """This process's folder under ``spark.checkpoint.dir``; under this machine's
    temporary folder only where the session names none and runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-tables")
    return f"{root.rstrip('/')}/graphloom-{_RUN}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{next(_NEXT):05d}-{name}"


def dealt(df: DataFrame) -> DataFrame:
    """``df``, joined by dealing both sides out by key. Spark takes a file's size for a
    table's, and compressed ids are many times smaller than in memory: by that guess it
    collects tables on the driver that don't fit there."""
    return df.hint("merge")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written and read again; joins with it are ``dealt``."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return dealt(df.sparkSession.read.schema(df.schema).parquet(path))


def stored_counted(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, int]:
    """``stored``, and how many rows were written, in one job."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name, path)
    return out, seen.get["n"]


def purge(spark: SparkSession) -> None:
    """Delete every table this process has stored. Call it once results are consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
