"""Shards by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a row's hash.  A bucket is
split on its next bit only while it exceeds the byte limit, so each
shard is the shortest prefix whose rows fit.  The directory is worked out from
byte counts per prefix, ``step`` bits at a time; only rows of buckets that are
still too large take part in the next round.

The first 30 bits come from the key, so rows of one key stay together
while their bucket fits; the other 30 come from the row, so a key that fills more
than a shard is split like everything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelake.llm import work

BITS = 60


def _half(text: Column) -> Column:
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 2)


def _prefix(column: str, bits: int) -> Column:
    return F.shiftright(F.col(column), bits) if bits < BITS else F.lit(0).cast("long")


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", step: int = 8) -> DataFrame:
    """The shard of every row of ``docs``.

    Returns ``doc_id, n_bytes, shard, depth``: the bytes of the text, the
    hash prefix in binary (empty if one shard holds everything) and its length.
    Every shard holds at most ``limit`` bytes, except that a single text over the limit is a
    shard of its own, since texts stay whole.  A null text has no bytes; a null key
    counts as the empty one; repeated rows are placed one by one; without rows the result is empty.
    """
    by = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), by.alias("by"), F.monotonically_increasing_id().alias("row"))
    bits = F.shiftleft(_half(F.col("by")), 30) + _half(F.concat_ws(":", "by", "row"))
    open_ = work.save(rows.select("doc_id", "n_bytes", bits.alias("bits")))

    placed, base = [], 0
    while True:
        width = min(step, BITS - base)
        at = open_.withColumn("sub", _prefix("bits", BITS - base - width))
        counts = work.save(at.groupBy("sub").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")))
        every = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(width)))).withColumn("prefix", F.expr(f"shiftright(sub, {width} - k)"))
        fits = every.groupBy("k", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where((F.col("bytes") <= limit) | (F.col("rows") == 1) | ((F.lit(base) + F.col("k")) == BITS))
        leaf = work.save(every.join(fits.select("k", "prefix"), ["k", "prefix"]).groupBy("sub").agg(F.min("k").alias("k")))
        text = F.when(F.lit(base) + F.col("k") == 0, "").otherwise(F.lpad(F.bin(F.expr(f"shiftright(bits, {BITS - base} - k)")), F.lit(base) + F.col("k"), F.lit("0")))
        placed.append(at.join(leaf, "sub").select("doc_id", "n_bytes", text.alias("shard"), (F.lit(base) + F.col("k")).cast("long").alias("depth")))
        rest = counts.join(leaf, "sub", "left_anti")
        if rest.isEmpty():
            return reduce(DataFrame.union, placed)
        open_ = work.save(at.join(rest.select("sub"), "sub", "left_semi").select("doc_id", "n_bytes", "bits"))
        base += width


def write_shards(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Write ``docs`` as Parquet with a folder for each shard; returns the shards with their rows and bytes.

    ``doc_id`` must be unique here, since rows are joined to their shards by it.
    """
    shards = work.save(extendible_shards(docs, limit))
    docs.join(shards.select("doc_id", F.concat(F.lit("b"), "shard").alias("shard")), "doc_id").repartition("shard").sortWithinPartitions("shard", "doc_id").write.partitionBy("shard").parquet(path)
    return shards.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
