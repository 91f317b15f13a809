"""Intermediate tables of iterative operators, in the folder that driver and executors share.

``save`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it again.  That cuts the lineage, computes every row once, survives the loss of
an executor, and gives the optimizer the true size of what it joins next.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session, as in tests, may do without; it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pacelake.scratch", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pacelake-")
        spark.conf.set("pacelake.scratch", where)
    return f"{where.rstrip('/')}/pacelake-{spark.sparkContext.applicationId}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended, instead of when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The same rows, read back from a table in the shared folder; if ``tidy``, the shuffle files of making them are gone by then."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``save`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
