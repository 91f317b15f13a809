"""How far apart the sources of a language are in their words, by joint histograms of counts.

A task counts the terms of a few megabytes by (lang, source) with array operations, Spark sums these counts.
A source's share of a term depends on its count alone, so the divergence of two sources needs no
sum over terms: it is enough to know how many terms have the counts (i, j) in them.  Terms are dealt to
blocks; a task holds a block of complete rows, zeros implied, and tallies each pair of
sources over it.  What leaves a task are distinct combinations with their multiplicity, never pairs of
rows.  The distance is evaluated once for each combination of the whole corpus, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: Documents of its language that a kept term occurs in.
DOCUMENTS = 10
#: Shares are in units of one part in so many.
UNIT = 1_000_000_000
#: Terms of a group that are listed.
TOP = 10
#: Bytes of text that are counted at once.
CHUNK = 2 << 20
#: Counts of a block of terms, zeros included.
CELLS = 1 << 22

#: Bytes that part terms: ASCII other than letters.
_APART = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
_TERMS = "lang string, source string, term string, n long, docs long"


def _counted(buf: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each (group, term): the group, start and end of the term in ``buf``, its occurrences and its documents."""
    start, end, before = tb.words(buf, offsets, _APART)
    h = tb.span_hashes(tb.prefix_sums(buf, tb.FOLDED), start, end)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    key, n = np.unique(which.astype(np.int64) * len(group) + doc, return_counts=True)
    term, doc = key // len(group), key % len(group)
    groups = int(group.max()) + 1
    pair, at = np.unique(term * groups + group[doc], return_inverse=True)
    word = first[pair // groups]
    return pair % groups, start[word], end[word], np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each (lang, source) group, and the group's documents that have it.

    Terms are runs of letters A-Z and a-z and of characters beyond ASCII; only A-Z are lower-cased. A null text, lang or source counts as empty.
    Rows repeated are counted as often as they occur; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            seen: dict = {}
            group = np.array([seen.setdefault((r["lang"], r["source"]), len(seen)) for r in both.to_pylist()], dtype=np.int64)
            names = list(seen)
            for first, end, buf, offsets in tb.chunks(batch.column(2), CHUNK):
                g, a, b, n, d = _counted(buf, offsets, group[first:end])
                if not len(g):
                    continue
                size = b - a
                ends = np.cumsum(size)
                text = tb.LOWER[buf[np.repeat(a - (ends - size), size) + np.arange(ends[-1])]]
                at = np.concatenate(([0], ends)).astype(np.int32)
                terms = pa.Array.from_buffers(pa.string(), len(g), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes())])
                made = [*(pa.array([x[k] for x in names], pa.string()).take(pa.array(g)) for k in (0, 1)), terms, pa.array(n), pa.array(d)]
                yield pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "n", "docs"])

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, _TERMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _tally(counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, count in a, count in b, terms) for each two columns a < b of a block of terms."""
    levels = [np.unique(counts[:, k], return_inverse=True) for k in range(counts.shape[1])]
    for b in range(1, len(levels)):
        own, at = levels[b]
        for a in range(b):
            other, by = levels[a]
            key, n = np.unique(by * len(own) + at, return_counts=True)
            yield a, b, other[key // len(own)], own[key % len(own)], n


def joint_histograms(terms: DataFrame) -> DataFrame:
    """``lang, a, b, count_a, count_b, terms`` for sources a < b of ``terms`` (``lang, sources, cells``), zeros included.

    ``sources`` is the number of sources of the language, which are numbered from 0 on; ``cells`` lists (source, n) of a term where n > 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code, wide = np.asarray(lang.indices), np.asarray(batch.column(1))
            cells, ends = batch.column(2).flatten(), np.asarray(batch.column(2).offsets)
            source, n = (np.asarray(cells.field(k)) for k in (0, 1))
            for one in np.unique(code):
                rows = np.flatnonzero(code == one)
                columns = int(wide[rows[0]])
                step = max(1, CELLS // max(1, columns))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    block = np.zeros((len(some), columns), dtype=np.int64)
                    for k, r in enumerate(some):
                        block[k, source[ends[r] - ends[0] : ends[r + 1] - ends[0]]] = n[ends[r] - ends[0] : ends[r + 1] - ends[0]]
                    held, size = [], 0
                    for a, b, left, right, terms_ in _tally(block):
                        held.append((np.full(len(left), a), np.full(len(left), b), left, right, terms_))
                        size += len(left)
                        if size > CELLS // 16:
                            yield _rows(lang.dictionary[int(one)], held)
                            held, size = [], 0
                    if held:
                        yield _rows(lang.dictionary[int(one)], held)

    def _rows(lang: pa.Scalar, held: list) -> pa.RecordBatch:
        made = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(made[0]), pa.string()), *made], ["lang", "a", "b", "count_a", "count_b", "terms"])

    found = terms.select("lang", F.col("sources").cast("int"), "cells").mapInArrow(run, "lang string, a long, b long, count_a long, count_b long, terms long")
    return found.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("terms").alias("terms"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), in decimals wide enough for any corpus."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0)) DIV CAST({total} + 2 * {kept} AS DECIMAL(20,0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)) of shares of at most UNIT + 1, so in longs."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def divergence(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of ``docs``.

    A language keeps the terms of at least ``documents`` of its documents. In part ``pair`` an item is another source of the language and the value the sum
    of distances over all kept terms, 0 if there are none; in part ``term`` it is one of the ``top`` kept terms that the group has and uses more than its language does.
    Higher values come first, ties by UTF-8. See ``term_counts`` for odd rows; a group without terms has its pairs, one without a second source has none;
    without rows the result is empty.
    """
    counts = work.save(term_counts(docs))
    by_source = Window.partitionBy("lang").orderBy("source")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.withColumn("at", F.row_number().over(by_source) - 1)
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    cells = counts.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("at", "n")).alias("cells"), F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = work.save(cells.where(F.col("docs") >= documents).join(sources, "lang").select("lang", "term", "total", "sources", "cells"))

    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    each = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.at", "c.n")
    of_group = groups.join(of_lang, "lang").join(each.groupBy("lang", "at").agg(F.sum("n").alias("group_total")), ["lang", "at"], "left").na.fill(0, ["group_total"])
    of_group = work.save(of_group.select("lang", "source", "at", "v", "lang_total", "group_total"))

    tallies = joint_histograms(kept)
    for side in "ab":
        tallies = tallies.join(of_group.select("lang", F.col("at").alias(side), "v", F.col("group_total").alias(f"total_{side}")), ["lang", side] if side == "a" else ["lang", side, "v"])
    tallies = tallies.withColumns({"p": share("count_a", "total_a", "v"), "q": share("count_b", "total_b", "v")}).withColumn("value", F.col("terms") * distance("p", "q"))
    sums = tallies.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    mirrored = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "value").select("lang", "e.x", "e.y", "value")
    two = groups.select("lang", "source", F.col("at").alias("x")).join(groups.select("lang", F.col("source").alias("item"), F.col("at").alias("y")), "lang").where("x <> y")
    pairs = two.join(mirrored, ["lang", "x", "y"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    own = each.join(of_group, ["lang", "at"]).withColumns({"p": share("n", "group_total", "v"), "q": share("total", "lang_total", "v")}).where("p > q")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))
