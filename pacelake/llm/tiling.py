"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences without case and punctuation.
A document and an item are compared if they share a seed of ``min_match`` words.
Tiles are the longest common runs that no earlier tile touches: all
runs of at least s words are found by running Karp-Rabin hashes of s words, marked longest first (what a tile leaves of a longer run comes in its own turn),
and s is then lowered, to ``min_match`` at last.  What counts is the share of the item's words
that tiles cover, so a passage whose parts were put in another order is found as well.

Seeds are joined in one of two ways.  A benchmark of up to ``BROADCAST`` bytes goes to every
executor, so documents are read once and never shuffled.  A larger one is joined by seed.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: Bytes of benchmark text that may be broadcast.
BROADCAST = 16 << 20

_MATCHES = "doc_id long, item_id long, covered long, item_words long"


def _sequences(column: pa.Array) -> Iterator[np.ndarray]:
    for first, end, buf, offsets in tb.chunks(pc.utf8_lower(column)):
        word, before = tb.word_hashes(buf, offsets, apart=tb.IS_MARK)
        for i in range(end - first):
            yield word[before[i] : before[i + 1]]


def _runs(word: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and Karp-Rabin hashes of the runs of s words that no tile touches."""
    if len(word) < s:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h, _ = tb.gram_hashes(word, np.array([0, len(word)]), s)
    sums = np.concatenate(([0], np.cumsum(free)))
    at = np.flatnonzero(sums[s:] - sums[:-s] == s)
    return at, h[at]


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, words) of the tiles."""
    free_i, free_d = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(min_match, min(len(item), len(doc)))
    while True:
        at_i, h_i = _runs(item, free_i, s)
        at_d, h_d = _runs(doc, free_d, s)
        hit = np.isin(h_d, h_i)
        places = defaultdict(list)
        for p, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
            places[h].append(p)
        found: list[tuple[int, int, int]] = []
        any_ = False
        ended: dict[int, int] = {}  # per diagonal, where the last run that was extended ends
        for q, h in zip(at_d[hit].tolist(), h_d[hit].tolist(), strict=True):
            for p in places[h]:
                if ended.get(q - p, -1) > q:
                    continue
                n = s
                while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                ended[q - p] = q + n
                found.append((-n, p, q))
        heapq.heapify(found)
        while found:
            n, p, q = heapq.heappop(found)
            free = free_i[p : p - n] & free_d[q : q - n]
            if free.all():
                free_i[p : p - n] = free_d[q : q - n] = False
                tiles.append((p, q, -n))
                any_ = True
            else:  # what earlier tiles have left of it comes in its own turn
                edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if b - a >= s:
                        heapq.heappush(found, (a - b, p + a, q + a))
        if s == min_match and not any_:
            return tiles
        s = max(min_match, s // 2)
        if free_i.sum() < min_match:
            return tiles


def _match(item: np.ndarray, doc: np.ndarray, min_match: int) -> int:
    """Words of the item that tiles cover. An item of fewer words than a seed counts if it occurs as a whole."""
    return sum(n for _, _, n in tile(item, doc, min(min_match, max(1, len(item)))))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("item")).where("item_id is not null").groupBy("item_id", "item").count().drop("count")


def _by_broadcast(texts: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    rows = items.orderBy("item_id", "item").toPandas()
    words = list(_sequences(pa.array(rows["item"], pa.string()))) if len(rows) else []
    seeds = defaultdict(list)  # by length of the seed: (hash, item)
    for k, w in enumerate(words):
        n = min(min_match, len(w))
        if n:
            seeds[n] += [(h, k) for h in tb.gram_hashes(w, np.array([0, len(w)]), n)[0].tolist()]
    tables = {n: (np.array(sorted({h for h, _ in s}), dtype=np.uint64), _listed(s)) for n, s in seeds.items()}
    shared = texts.sparkSession.sparkContext.broadcast((rows["item_id"].tolist(), words, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, tables = shared.value
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out: list[tuple] = []
            base = 0
            for first, end, buf, offsets in tb.chunks(pc.utf8_lower(batch.column(1))):
                word, before = tb.word_hashes(buf, offsets, apart=tb.IS_MARK)
                pairs = set()
                for n, (sorted_, where) in tables.items():
                    gram, starts = tb.gram_hashes(word, before, n)
                    at = np.searchsorted(sorted_, gram)
                    hits = np.flatnonzero(sorted_[np.minimum(at, len(sorted_) - 1)] == gram)
                    owner = np.searchsorted(starts, hits, side="right") - 1
                    for d, h in set(zip(owner.tolist(), gram[hits].tolist(), strict=True)):
                        pairs.update((d, k) for k in where[h])
                for d, k in sorted(pairs):
                    out.append((docs[base + d], ids[k], _match(words[k], word[before[d] : before[d + 1]], min_match), len(words[k])))
                base += end - first
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "covered", "item_words"])

    return texts.mapInArrow(run, _MATCHES)


def _listed(seeds: list[tuple[int, int]]) -> dict[int, list[int]]:
    out = defaultdict(set)
    for h, k in seeds:
        out[h].add(k)
    return {h: sorted(k) for h, k in out.items()}


def _seeds(texts: DataFrame, min_match: int, name: str, sizes: list[int]) -> DataFrame:
    """Distinct seed hashes of each text; an item of fewer words than a seed is one seed, a document has seeds of all ``sizes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for w in _sequences(batch.column(1)):
                n = [min(min_match, len(w))] if name == "item_id" else sizes
                found.append(np.unique(np.concatenate([tb.gram_hashes(w, np.array([0, len(w)]), k)[0] ^ np.uint64(k) for k in n if k] or [np.zeros(0, dtype=np.uint64)])))
            who = np.repeat(np.array(ids, dtype=np.int64), [len(f) for f in found]) if ids else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64))], [name, "seed"])

    return texts.mapInArrow(run, f"{name} long, seed long")


def _by_join(texts: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    pairs = _seeds(texts, min_match, "doc_id", list(range(1, min_match + 1))).join(_seeds(items, min_match, "item_id", []), "seed").select("doc_id", "item_id").distinct()
    rows = pairs.join(items, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = list(zip(_sequences(batch.column(2)), _sequences(batch.column(3)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_match(i, d, min_match) for i, d in two], pa.int64()), pa.array([len(i) for i, _ in two], pa.int64())], ["doc_id", "item_id", "covered", "item_words"])

    return rows.mapInArrow(run, _MATCHES)


def tiling_matches(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, item_id, covered, item_words`` of every document and item that share a seed.

    Null and empty texts share none. Rows without an id are left out. Repeated rows of documents give repeated
    results, those of items don't. Columns other than the ids and ``text`` are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where("doc_id is not null")
    items = work.save(_items(benchmark))
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    return (_by_broadcast if size <= broadcast else _by_join)(texts, items, min_match)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, coverage`` of every row of ``docs``.

    ``item_ids`` lists, with commas, the items of which tiles cover a share of ``coverage`` or more; ``coverage`` is the
    largest share, 0 where nothing is shared.
    """
    found = tiling_matches(docs, benchmark, min_match).withColumn("share", F.col("covered") / F.col("item_words"))
    hit = F.when(F.col("share") >= coverage, F.col("item_id"))
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(hit)).alias("items"), F.max("share").alias("share"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(each, "doc_id", "left").select(
        "doc_id", (F.coalesce(F.size("items"), F.lit(0)) > 0).alias("contaminated"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("coverage")
    )
