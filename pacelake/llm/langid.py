"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams, weighted by TF-IDF and scaled to
length one.  Every language has several centroids, found by spherical
k-means on a bounded sample of labelled rows that has rows of every language; a text gets the language of the centroid with
the largest cosine, and is marked as rejected where even that is too far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb

#: Labelled rows that the centroids are fitted to: the first by a hash of doc_id of all, and the first of each language.
SAMPLE = 4_000
EACH = 500
SLOTS = 4096
CENTROIDS = 4
UNKNOWN = "und"

#: Letters in lower case; other ASCII is a space. Bytes of other letters stay as they are.
_LETTERS = tb.LOWER.astype(np.uint32)
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


@dataclass(frozen=True)
class Centroids:
    languages: list[str]  # of each centroid
    weights: np.ndarray  # inverse document frequency of each slot
    vectors: np.ndarray  # centroid by slot, each of length one
    least: np.ndarray  # cosine under which a text is too far from the centroid


def frequencies(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of hashed 1- to 3-grams, a block of texts by slots at a time."""
    for first, end, buf, offsets in tb.chunks(column):
        n = end - first
        row = np.repeat(np.arange(n, dtype=np.int64) * SLOTS, np.diff(offsets))
        x = _LETTERS[buf]
        out = np.zeros(n * SLOTS, dtype=np.int64)
        code = np.zeros(len(x), dtype=np.uint32)
        for k in range(3):
            if len(x) <= k:
                break
            code = (code[: len(x) - k] << np.uint32(8)) | x[k:]
            whole = row[: len(code)] == row[k:]
            mixed = (code + np.uint32(k << 24)) * np.uint32(2654435761)
            out += np.bincount((row[: len(code)] + (mixed >> np.uint32(20)))[whole], minlength=n * SLOTS)
        yield out.reshape(n, SLOTS)


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * weights
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.minimum(np.rint(16 * np.log1p(row)), 255).astype(np.uint8).tobytes() for block in frequencies(batch.column(1)) for row in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), batch.column(2)], ["doc_id", "counts", "lang"])


def _kmeans(v: np.ndarray, k: int, dice: np.random.Generator) -> np.ndarray:
    centre = v[dice.choice(len(v), size=min(k, len(v)), replace=False)]
    for _ in range(12):
        near = np.argmax(v @ centre.T, axis=1)
        centre = np.stack([v[near == c].mean(axis=0) if (near == c).any() else centre[c] for c in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def _of_each(rows: DataFrame, each: int) -> DataFrame:
    """``doc_id`` of the first ``each`` ids of every ``lang``, by hash.

    A language's ids are first thinned out by a threshold on the hash, so that about four times as many are left as are wanted, however many there are; only these are ranked.
    """
    ids = rows.distinct().withColumn("h", F.xxhash64("doc_id"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))  # the model holds centroids for each of these rows
    near = ids.join(F.broadcast(counts), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= 4 * each)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id")


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, each: int = EACH) -> Centroids:
    """Centroids of every language, from ``sample`` rows that have a language and a letter and are not held out, and ``each`` rows of each language."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).where(~held_out(F.col("doc_id")))
    chosen = _of_each(known.select("doc_id", F.lit("").alias("lang")), sample)  # of all languages together
    chosen = chosen.union(_of_each(known.select("doc_id", "lang"), each)).distinct()
    rows = known.join(F.broadcast(chosen), "doc_id").mapInArrow(_pack, "doc_id long, counts binary, lang string")
    # of repeated rows of a document one counts, so that no more than the sample goes to the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "counts")).alias("row")).select("doc_id", "row.*").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "counts"], kind="stable")
    counts = np.frombuffer(b"".join(rows["counts"]), dtype=np.uint8).reshape(len(rows), SLOTS)
    weights = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    names, dice = rows["lang"].to_numpy(), np.random.default_rng(7)
    languages, found, least = [], [], []
    for lang in sorted(set(names)):
        mine = vectors(np.expm1(counts[names == lang].astype(np.float32) / 16), weights)
        centre = _kmeans(mine, centroids, dice)
        cosine = mine @ centre.T
        near = np.argmax(cosine, axis=1)
        for c in range(len(centre)):
            languages.append(lang)
            found.append(centre[c])
            own = cosine[near == c, c]
            least.append(float(np.quantile(own, 0.01)) * 0.8 if len(own) else 1.0)
    return Centroids(languages, weights, np.stack(found) if found else np.zeros((0, SLOTS), dtype=np.float32), np.array(least))


def languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row of ``docs``.

    ``score`` is the cosine to the nearest centroid. ``rejected`` marks texts that are further from it
    than nearly all texts it was made from. A text that is null or has no letter is ``und``, with score 0, and
    rejected, as is every text if the model has no centroid. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, far = [], [], []
            for block in frequencies(batch.column(1)):
                cosine = vectors(block, model.weights) @ model.vectors.T
                near = np.argmax(cosine, axis=1) if model.languages else np.zeros(len(block), dtype=int)
                best = cosine[np.arange(len(block)), near] if model.languages else np.zeros(len(block))
                pred += [model.languages[k] if model.languages else UNKNOWN for k in near]
                score.append(np.clip(best.astype(np.float64), 0, 1))
                far.append(best < model.least[near] if model.languages else np.ones(len(block), dtype=bool))
            s = np.concatenate(score) if score else np.zeros(0)
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred = [p if has else UNKNOWN for p, has in zip(pred, letter, strict=True)]
            rejected = (np.concatenate(far) if far else np.zeros(0, dtype=bool)) | ~letter
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(letter, s, 0.0), pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
