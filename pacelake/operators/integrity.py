"""Checks between tables: membership, bindings, totals and schemas; and the exact order in which datasets are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def outside(rows: DataFrame, inventory: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose provenance isn't in the inventory; none may be left."""
    return rows.join(inventory.select(*on).distinct(), on, "left_anti")


def bound(rows: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Rows with the one audit of their ``key``; a row without an audit, or with several, fails the job."""
    each = audits.groupBy(key).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in audits.columns if c != key])
    checked = rows.join(each, key, "left").withColumn("__n", F.when(F.col("__n") == 1, F.lit(1)).otherwise(F.raise_error(F.concat(F.lit(f"{key} without exactly one audit: "), F.col(key).cast("string"))).cast("int")))
    return checked.where("__n = 1").drop("__n")


def unreferenced(blobs: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """``key, referenced`` of every blob."""
    known = references.select(key).distinct().withColumn("referenced", F.lit(True))
    return blobs.select(key).distinct().join(known, key, "left").withColumn("referenced", F.coalesce("referenced", F.lit(False)))


def nested(links: DataFrame, key: str, value: str, size: int = 1000) -> DataFrame:
    """``key, part, rows``: the links of each key as sorted lists of at most about ``size`` rows, dealt by hash, so that no list grows with its key."""
    counts = links.groupBy(key).agg(F.count("*").alias("__n"))
    dealt = links.join(counts, key).withColumn("part", F.pmod(F.crc32(F.col(value).cast("string")), F.ceil(F.col("__n") / size)).cast("long"))
    return dealt.groupBy(key, "part").agg(F.sort_array(F.collect_list(value)).alias("rows"))


def totals_agree(parts: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """One row: the sum of ``name`` over parts, the total, and whether they are equal. Both sides are aggregates of one row."""
    a = parts.agg(F.coalesce(F.sum(name), F.lit(0)).cast("long").alias("part_sum")).withColumn("__one", F.lit(1))
    b = total.agg(F.coalesce(F.sum(name), F.lit(0)).cast("long").alias("total")).withColumn("__one", F.lit(1))
    return a.join(b, "__one").drop("__one").withColumn("agree", F.col("part_sum") == F.col("total"))


def schema_report(df: DataFrame, expected: StructType) -> DataFrame:
    """``column_name, expected, actual, matches`` of every column that is there or should be."""
    want, have = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (expected, df.schema))
    rows = [(c, want.get(c), have.get(c), want.get(c) == have.get(c)) for c in sorted(want.keys() | have.keys())]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string, matches boolean")


def differences(stated: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of both has, with ``side``; an authority holds if there are none."""
    other = recomputed.select(stated.columns)
    return stated.exceptAll(other).withColumn("side", F.lit("stated")).union(other.exceptAll(stated).withColumn("side", F.lit("recomputed")))


def relationship_counts(left: DataFrame, key: str, right: DataFrame, target: str, name: str) -> DataFrame:
    """One row of counters of a relationship by equal keys: nothing is inferred."""
    known = right.groupBy(F.col(target).alias(key)).agg(F.count("*").alias("__n"))
    each = left.select(key).join(known, key, "left")
    total = lambda c, n: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(n)
    out = each.agg(total(F.col(key).isNotNull(), "eligible_count"), total(F.col("__n") == 1, "explicit_link_count"), total(F.col(key).isNotNull() & F.col("__n").isNull(), "unresolved_count"), total(F.col("__n") > 1, "ambiguous_count"))
    return out.select(F.lit(name).alias("relationship_id"), "*", F.lit(False).alias("inference_performed"))


def relationship_projection(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named relationships, each exactly once and none by inference; anything else fails the job."""
    each = rows.where(F.col("relationship_id").isin(names)).groupBy("relationship_id").agg(F.count("*").alias("__n"), F.bool_or("inference_performed").alias("inference_performed"), *[F.sum(c).alias(c) for c in ("eligible_count", "explicit_link_count", "unresolved_count", "ambiguous_count")])
    wanted = rows.sparkSession.createDataFrame([(n,) for n in names], "relationship_id string")
    fine = (F.col("__n") == 1) & ~F.col("inference_performed")
    out = wanted.join(each, "relationship_id", "left").withColumn("relationship_id", F.when(fine, F.col("relationship_id")).otherwise(F.raise_error(F.lit("a relationship is missing, repeated or inferred"))))
    return out.drop("__n")


def published_order(df: DataFrame, key: Column, *then: Column) -> DataFrame:
    """The total order of a published dataset: by the text of its key (so 10 goes before 9), then by the rest. Only for sinks."""
    return df.orderBy(key.cast("string"), *then)


def stable_order(df: DataFrame) -> DataFrame:
    """Holds and conflicts in the order of their JSON text, with fields by name."""
    return df.orderBy(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
