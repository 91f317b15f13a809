"""A corpus pipeline: five stages from raw documents to sampled SentencePiece ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.llm import pieces, quality, suffix, tiling, work
from pacelake.llm.jaccard import jaccard_links
from pacelake.llm.queries import PIECES, table

#: Documents are near copies from this similarity of their sets of five-word shingles on, in percent.
SHINGLE, SIMILAR = 5, 80
#: Bytes of a passage that counts as repeated.
PASSAGE = 200


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from the labels of those that are not held out."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    links = jaccard_links(docs, n=SHINGLE, percent=SIMILAR)
    return docs.join(links.where(F.col("doc_id") != F.col("component_id")).select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat within or across documents."""
    return suffix.without_repeats(docs, PASSAGE)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order of its parts."""
    found = tiling.contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_sha256, lossless, ids`` of each text."""
    return pieces.round_trips(docs, PIECES, keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("decontamination", uncontaminated),
    ("pieces", sampled_pieces),
]

#: Rule ensembles and sampled segmentations have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir))
    return docs
