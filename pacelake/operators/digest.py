"""Digests of tables that don't depend on the order of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that ``sorted_digest`` takes.
SORTED_ROWS = 100_000


def row_number60(text: Column) -> Column:
    """The first 60 bits of the row's SHA-256, as a decimal that sums don't overflow."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def multiset_digest(df: DataFrame, text: Column) -> DataFrame:
    """``row_count, digest``: the hash of the sum of all row hashes, combined before any shuffle, so of any size."""
    total = df.agg(F.count("*").alias("row_count"), F.sum(row_number60(text)).alias("total"))
    return total.select(F.col("row_count").cast("long").alias("row_count"), F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), F.coalesce(F.col("total"), F.lit(0)).cast("string")), 256).alias("digest"))


def sorted_digest(df: DataFrame, text: Column) -> DataFrame:
    """``row_count, digest``: SHA-256 over the sorted rows joined by line feeds, as published datasets state it.

    That is one sequence, so it is for datasets that fit a task: beyond ``SORTED_ROWS`` rows the job fails, and ``tree_digest`` serves any size.
    """
    out = df.select(text.alias("t")).limit(SORTED_ROWS + 1).agg(F.count("*").cast("long").alias("row_count"), F.sha2(F.array_join(F.sort_array(F.collect_list("t")), "\n"), 256).alias("digest"))
    return out.select("row_count", F.when(F.col("row_count") <= SORTED_ROWS, F.col("digest")).otherwise(F.raise_error(F.lit(f"more than {SORTED_ROWS} rows"))).alias("digest"))


#: Rows of a leaf of a hash tree, about.
LEAF_ROWS = 1 << 16


def tree_digest(df: DataFrame, text: Column, depth: int | None = None) -> DataFrame:
    """``row_count, digest`` of tables of any size: rows' hashes are sorted within leaves, of which there are 16 ** (2 * depth), and each level hashes the one below.

    Leaves are the leading hex digits of a row's hash, so they are even and don't depend on how rows are partitioned. Without a ``depth`` it follows
    from the number of rows, so that no leaf has many more than ``LEAF_ROWS``; a table has the same digest wherever and however it is stored.
    """
    if depth is None:
        rows, depth = df.count(), 0
        while rows > LEAF_ROWS << (8 * depth):
            depth += 1
    each = df.select(F.sha2(text, 256).alias("h")).groupBy(F.substring("h", 1, 2 * depth).alias("leaf")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    for level in range(depth - 1, -1, -1):
        each = each.groupBy(F.substring("leaf", 1, 2 * level).alias("leaf")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("leaf", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return each.select(F.col("n").cast("long").alias("row_count"), F.col("h").alias("digest"))


#: Hashes that go through the last step of ``sequence_digest`` as one row, 4 KiB of text.
PIECE_ROWS = 64


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, whole = 0, hashlib.sha256()
    for batch in batches:
        for n, text in zip(batch["n"].to_pylist(), batch["text"].to_pylist(), strict=True):
            whole.update(("\n" if count else "").encode() + text.encode())
            count += n
    if count:
        yield pa.RecordBatch.from_pydict({"row_count": pa.array([count], pa.int64()), "digest": [whole.hexdigest()]})


def sequence_digest(df: DataFrame, text: Column) -> DataFrame:
    """``row_count, digest``: SHA-256 over the sorted hashes of all rows, joined by line feeds, of tables of any size; no row if there is none.

    Hashes are sorted by their leading digits on all machines. SHA-256 of one sequence has no parts that could be put together, so its last step reads the
    sorted pieces, 65 bytes a row, in one task; that holds a batch of them at a time.
    """
    leaves = df.select(F.sha2(text, 256).alias("h")).groupBy(F.substring("h", 1, 4).alias("leaf")).agg(F.sort_array(F.collect_list("h")).alias("h"))
    starts = F.sequence(F.lit(1), F.size("h"), F.lit(PIECE_ROWS))
    pieces = leaves.select("leaf", F.explode(F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("h", at, PIECE_ROWS).alias("h")))).alias("piece"))
    pieces = pieces.select("leaf", "piece.at", F.size("piece.h").alias("n"), F.array_join("piece.h", "\n").alias("text"))
    return pieces.repartition(1).sortWithinPartitions("leaf", "at").mapInArrow(_chained, "row_count long, digest string")


def build_digest(records: DataFrame, variants: DataFrame, contents: DataFrame, versions: dict[str, str]) -> DataFrame:
    """``record_count, content_count, digest`` of a build: of its merged records, its variants, the contents it was made of and the versions of what made it.

    ``records`` have ``dataset, canonical_key, record_sha256, presence_pattern``, ``variants`` ``dataset, canonical_key, signature, snapshot_orders``, ``contents`` ``content_id``.
    One changed field of one record changes the digest; the order of rows, partitions and snapshots processed doesn't. Both lists are hashed as one sequence, however long.
    """
    merged = records.select(F.to_json(F.array("dataset", "canonical_key", "record_sha256", "presence_pattern")).alias("t"))
    apart = variants.select(F.to_json(F.array("dataset", "canonical_key", "signature", "snapshot_orders")).alias("t"))
    stated = F.to_json(F.array(*[F.lit(f"{name}={versions[name]}") for name in sorted(versions)]))
    one = sequence_digest(merged.union(apart), F.col("t")).select(F.col("row_count").alias("record_count"), F.col("digest").alias("records"), F.lit(1).alias("one"))
    other = sequence_digest(contents.select(F.col("content_id").cast("string").alias("c")).distinct(), F.col("c")).select(F.col("row_count").alias("content_count"), F.col("digest").alias("contents"), F.lit(1).alias("one"))
    whole = one.join(other, "one", "full")  # at most a row each
    empty = F.lit("")
    return whole.select(F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("content_count", F.lit(0)).alias("content_count"), F.sha2(F.concat_ws("\n", stated, F.coalesce("records", empty), F.coalesce("contents", empty)), 256).alias("digest"))
