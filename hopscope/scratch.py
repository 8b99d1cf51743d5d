"""Tables that cut a plan where its result is used several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; of this process alone where Spark is local and names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="hopscope-files-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


_OWN: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back; it survives the loss of executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of a few columns, broadcast if it has at most ``most`` rows; beyond that Spark joins it by shuffling."""
    return F.broadcast(table) if table.count() <= most else table
