"""The merge of snapshots as a stream: each micro-batch of observations is absorbed into a state that doesn't depend on the order of arrival.

The state is a table of collapsed observations, one row for each key and snapshot, whose columns are minima, maxima, sums and last values, so
rows of any batches can be put together again in any order. A batch writes only its own rows, below its number: a batch that runs twice overwrites
itself, and no batch rewrites what others have written. ``compact`` puts the rows of many batches together. A snapshot's place
in the history comes from its time of acquisition when the state is read, so one that arrives late takes its place among the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pacelake.operators import coverage, snapshot

_ROW = ["dataset", "canonical_key", "snapshot_id", "export_observed_at"]


def _together(rows: DataFrame) -> DataFrame:
    """Rows of the same key and snapshot as one."""
    last = F.max_by(F.struct("at", "record"), "at")
    each = rows.groupBy(*_ROW).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), last.alias("last"))
    return each.select(*_ROW, "lo", "hi", "n", F.col("last.at").alias("at"), F.col("last.record").alias("record"))


def _folders(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last batch that the newest complete base covers (-1 if there is none), and the folders that make the state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return -1, []
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = sorted((n for n in names if n.startswith(("base-", "batch-")) and done(n)), key=lambda n: int(n.split("-")[1]))
    base = max((int(n[5:]) for n in found if n.startswith("base-")), default=-1)
    return base, [f"{path}/{n}" for n in found if n == f"base-{base}" or n.startswith("batch-") and int(n[6:]) > base]


def absorb(batch: DataFrame, batch_id: int, path: str) -> None:
    """Add the observations of a batch to the state below ``path``; the same batch again changes nothing.

    Columns are those of ``snapshot.merge_observations`` without ``logical_order``. Rows without a key are only counted.
    """
    base, _ = _folders(batch.sparkSession, path)
    if batch_id <= base:
        return
    rows = batch.withColumn("logical_order", F.lit(0).cast("long"))
    none = F.coalesce(F.col("canonical_key"), F.lit("")) == ""
    named = snapshot.collapse(rows).drop("logical_order")
    # of rows without a key only their number is kept
    counted = rows.where(none).groupBy("dataset", "snapshot_id", "export_observed_at").agg(F.count("*").alias("n"))
    missing = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns if c not in counted.columns]
    named.unionByName(counted.select("*", *missing)).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")


def stream(observations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Absorb a stream of observations; ``trigger`` is that of Spark, by default all that is there (``availableNow``)."""
    return observations.writeStream.foreachBatch(lambda df, n: absorb(df, n, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state(spark: SparkSession, path: str) -> DataFrame:
    """One row for each key and snapshot that any batch had."""
    _, folders = _folders(spark, path)
    if not folders:
        raise ValueError(f"no batch has been absorbed below {path}")
    return _together(spark.read.parquet(*folders))


def compact(spark: SparkSession, path: str) -> None:
    """Put the rows of all batches together. Old folders go once the new one is complete; readers choose the newest complete base, so a crash loses nothing."""
    base, folders = _folders(spark, path)
    last = max((int(f.rsplit("-", 1)[1]) for f in folders), default=-1)
    if last <= base:
        return
    state(spark, path).write.mode("overwrite").parquet(f"{path}/base-{last}")
    for f in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, path: str, daily: Column | None = None, preserve: Column | None = None, snapshots: DataFrame | None = None) -> dict[str, DataFrame]:
    """The merge as of all batches so far, as ``snapshot.merge_observations`` has it, without the lists of single observations.

    ``snapshots`` (``snapshot_id, export_observed_at``) are those that count; by default those that have observations.
    """
    daily, preserve = (F.lit(False) if c is None else c for c in (daily, preserve))
    rows = state(spark, path)
    known = (rows if snapshots is None else snapshots).groupBy("snapshot_id").agg(F.min("export_observed_at").alias("observed_at"))
    order = coverage.logical_order(known, ["observed_at", "snapshot_id"]).drop("observed_at")
    placed = rows.join(F.broadcast(order), "snapshot_id")  # one row for each export of the history
    named = placed.where("canonical_key IS NOT NULL").withColumn("at", F.col("at").withField("logical_order", F.col("logical_order")))
    out = snapshot.merge_collapsed(named, order.count(), daily, preserve)
    seen = placed.groupBy("dataset").agg(F.sum("n").alias("observations"), F.sum(F.when(F.col("canonical_key").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    counters = out.pop("counters").union(snapshot.counters(seen, {"observation_count": F.col("observations"), "null_key_hold_count": F.col("nameless")}))
    return out | {"summary": snapshot.summarize(counters)}
