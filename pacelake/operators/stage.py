"""Tables that a job writes and reads again, below the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a local session may do without; it gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pacelake.scratch", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pacelake-")
        spark.conf.set("pacelake.scratch", where)
    return f"{where.rstrip('/')}/pacelake-{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows from a table: computed once, with true sizes, and nothing above is computed again if an executor is lost."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
