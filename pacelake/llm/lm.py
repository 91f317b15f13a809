"""Language-model scores by stupid backoff, from n-gram counts over all documents.

Documents are dealt into groups of about ``GROUP`` bytes by a hash. The n-grams of all orders of a group's documents are
summed up in the task that reads the texts, so that an n-gram leaves a group once, and dealt into buckets by
ranges of hashes. A bucket is counted over all groups, and what other groups have goes back to each group in the order in which its n-grams came.
There the hashes of its texts are worked out again, every word is scored and the scores are summed.
N-grams of a group that go to one bucket travel as one value, so the shuffles hold hashes and counts and nothing else.

The n-grams are counted in ``TURNS`` turns, each of those in one range of hashes, so that the disk never holds the shuffles of more than one.

The most frequent ``HOT`` n-grams are counted apart, by sums that are combined before the shuffle, and their totals, a table of fixed size, are broadcast.
Which ones these are is read off one document in ``EVERY``; it decides the route, never the result.

The counts are those of all documents.  A document's own n-grams are taken
off the counts that it is scored with, so that a text doesn't vouch for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: N-grams whose totals are broadcast, at most, and one in how many documents is looked at to find them.
HOT = 1 << 16
EVERY = 64
ALPHA = 0.4

#: Turns in which n-grams are counted, a power of two; and bits of hashes by which frequent ones are looked up.
TURNS, BITS = 4, 20

#: Bytes of text in a group; bytes of text for each bucket of a turn, and bits of their number at most.
GROUP, BUCKET, MOST = 1 << 21, 1 << 22, 12


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words before each text, and for k = 1 to ``order`` the hashes of the k-grams that end at each word (0 where the text has fewer words)."""
    word, before = tb.word_hashes(buf, offsets)
    place = np.arange(len(word)) - np.repeat(before[:-1], np.diff(before))
    out = [tb.mix(word)]
    for k in range(2, order + 1):
        # one word more than the gram that ends at the word before
        h = np.zeros(len(word), dtype=np.uint64)
        h[1:] = tb.mix(out[-1][:-1] + word[1:])
        h[place < k - 1] = 0
        out.append(h)
    return before, out


def _order(h: np.ndarray, known: int = 0) -> np.ndarray:
    """Places of hashes in their order, equal ones as they stand; all hashes have the same first ``known`` bits."""
    low = np.uint64((1 << max(1, len(h).bit_length())) - 1)
    key = ((h << np.uint64(known)) & ~low) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    by = (key & low).astype(np.int64)
    there = h[by]
    # places took the last bits of the hashes; where that has mixed up two of them, all are sorted as they are
    return np.argsort(h, kind="stable") if (there[1:] < there[:-1]).any() else by


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(sorted_[0]), dtype=bool)
    new[1:] = sorted_[0][1:] != sorted_[0][:-1]
    for x in sorted_[1:]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _own(before: np.ndarray, found: list[np.ndarray], turn: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, how often) of the distinct n-grams of each text, text by text; only those of one turn if it is given."""
    texts = np.repeat(np.arange(len(before) - 1), np.diff(before))
    keep = [np.flatnonzero((h != 0) if turn is None else (h != 0) & (_turn(h) == turn)) for h in found]
    text = np.concatenate([texts[k] for k in keep])
    flat = np.concatenate([h[k] for h, k in zip(found, keep, strict=True)])
    by = _order(flat, 0 if turn is None else _TURN_BITS)
    text, flat = text[by], flat[by]
    first = _firsts(flat, text)
    n = np.diff(np.append(first, len(flat)))
    text, flat = text[first], flat[first]
    by = np.argsort(text.astype(np.uint16) if len(before) <= 1 << 16 else text, kind="stable")
    return text[by], flat[by], n[by]


_TURN_BITS = (TURNS - 1).bit_length()


def _turn(h: np.ndarray) -> np.ndarray:
    """The turn that counts an n-gram: turns take ranges of hashes in their order."""
    return h >> np.uint64(64 - _TURN_BITS) if TURNS > 1 else np.zeros(len(h), dtype=np.uint64)


class Hot:
    """Places of hashes among sorted known ones, found by their leading bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        if len(known):
            self.first = np.zeros((1 << BITS) + 1, dtype=np.int32)
            np.cumsum(np.bincount((known >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS), out=self.first[1:])
            self.steps = int(np.diff(self.first).max())

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.known):
            return out
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.steps):
            place = at[left]
            same = self.known[place] == h[left]
            out[left[same]] = place[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def exploded(units: DataFrame, order: int, hot: np.ndarray, turn: int | None = None) -> DataFrame:
    """``h, unit, n``: a row for each distinct n-gram of each row of ``units`` (unit, text, copies) but those in ``hot``, in the order of ``units``; a second one for the other copies."""
    shared = units.sparkSession.sparkContext.broadcast(hot)
    names = ["h", "unit", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hot(shared.value)
        for batch in batches:
            unit, copies = (batch.column(k).to_numpy() for k in (0, 2))
            for first, _, buf, offsets in tb.chunks(batch.column(1)):
                text, h, n = _own(*grams(buf, offsets, order), turn)
                keep = known.places(h) < 0
                text, h, n = first + text[keep], h[keep].view(np.int64), n[keep]
                others = copies[text] - 1
                if others.any():
                    each = 1 + (others > 0)
                    n = np.repeat(n, each)
                    n[np.cumsum(each)[others > 0] - 1] *= others[others > 0]
                    text, h = np.repeat(text, each), np.repeat(h, each)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(unit[text]), pa.array(n)], names)

    out = units.select("unit", "text", "copies").mapInArrow(run, "h long, unit long, n long")
    # by_bucket sums n-grams up in the task that reads their texts, so that no row of them passes from Python to Spark and back
    out._made_of = (units, order, shared, turn)
    return out


def _values(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Numbers of eight bytes as binary values, those from one cut to the next in each."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``_values``, and the cuts."""
    data, offsets = tb.buffers(column)
    return data[offsets[0] : offsets[-1]].view(dtype), (offsets - offsets[0]) // 8


def by_bucket(rows: DataFrame, groups: int, bits: int) -> DataFrame:
    """``bucket, g, h, n``: the n-grams that each group has in each bucket, in the order of their hashes, and how often; ``rows`` are those of ``exploded`` for a turn, group by group.

    The sums are those of ``rows``, which themselves are not made: they come straight from the texts that ``rows`` are of.
    """
    units, order, shared, turn = rows._made_of
    known, shift = _TURN_BITS, np.uint64(64 - _TURN_BITS - bits)

    def found_in(texts: pa.Array, copies: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The hashes of the turn in order of place, and for how many copies each of them counts if not for one."""
        for first, end, buf, offsets in tb.chunks(texts):
            before, found = grams(buf, offsets, order)
            keep = [np.flatnonzero((h != 0) & (_turn(h) == turn)) for h in found]
            each = copies[first:end]
            times = np.repeat(each, np.diff(before)) if (each != 1).any() else None
            yield np.concatenate([h[k] for h, k in zip(found, keep, strict=True)]), None if times is None else np.concatenate([times[k] for k in keep])

    def summed(g: int, held: list[tuple[np.ndarray, np.ndarray | None]], hot: Hot) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        if all(x[1] is None for x in held):
            h.sort()
            first = _firsts(h)
            n = np.diff(np.append(first, len(h)))
        else:
            times = np.concatenate([np.ones(len(x[0]), dtype=np.int64) if x[1] is None else x[1] for x in held])
            by = _order(h, known)
            h = h[by]
            first = _firsts(h)
            n = np.add.reduceat(times[by], first) if len(first) else times
        h = h[first]
        keep = hot.places(h) < 0
        h, n = h[keep], n[keep]
        bucket = ((h >> shift) & np.uint64((1 << bits) - 1)).astype(np.int32)
        begin = _firsts(bucket)
        cut = np.append(begin, len(h))
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(np.full(len(begin), g)), _values(h, cut), _values(n, cut)], ["bucket", "g", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot(shared.value)
        at, held = -1, []
        for batch in batches:
            group, copies = batch.column(0).to_numpy() % groups, batch.column(2).to_numpy()
            begin = _firsts(group)
            for a, b in zip(begin, np.append(begin[1:], len(group)), strict=True):
                if group[a] != at and held:
                    yield summed(at, held, hot)
                    held = []
                at = int(group[a])
                held.extend(found_in(batch.column(1).slice(a, b - a), copies[a:b]))
        if held:
            yield summed(at, held, hot)

    return units.select("unit", "text", "copies").mapInArrow(run, "bucket int, g long, h binary, n binary")


def elsewhere(rows: DataFrame, bits: int) -> DataFrame:
    """``bucket, g, rest``: how often each n-gram in a row of ``by_bucket`` occurs in other groups."""

    def run(table: pa.Table) -> pa.Table:
        (h, cut), (n, _) = _numbers(table["h"], np.uint64), _numbers(table["n"], np.int64)
        by = _order(h, _TURN_BITS + bits)
        first = _firsts(h[by])
        rest = np.empty(len(h), dtype=np.int64)
        rest[by] = np.repeat(np.add.reduceat(n[by], first), np.diff(np.append(first, len(h))))
        return pa.table([table["bucket"], table["g"], _values(rest - n, cut)], ["bucket", "g", "rest"])

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, g long, rest binary")


def hot_totals(texts: DataFrame, order: int, hot: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of words of all texts, and the totals of the n-grams in ``hot``."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ = Hot(shared.value)
        counts = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, buf, offsets in tb.chunks(batch.column(1)):
                before, found = grams(buf, offsets, order)
                counts[-1] += before[-1]
                for h in found:
                    place = hot_.places(h)
                    counts[:-1] += np.bincount(place[place >= 0], minlength=len(counts) - 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["k", "n"])

    out = np.zeros(len(hot) + 1, dtype=np.int64)
    for k, n in texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # HOT + 1 rows at most
        out[k] = n
    return int(out[-1]), out[:-1]


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA, hot: int = HOT, every: int = EVERY) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z taken as a-z. At each word the longest n-gram
    of at most ``order`` words that other documents have is scored by its count over that of its first words, times ``alpha``
    for each word it is shorter; a single word by its count over all words, one that no other document has by ``alpha``
    over all words. ``log_score`` is the sum of natural logarithms. A text without words, null or empty, has 0 in both. Repeated rows count
    as documents of their own, and so do rows without doc_id, which are grouped by their texts; columns other than doc_id and text are ignored.
    N-grams are compared by 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # places of n-grams hold for one text, so rows that repeat a doc_id with another one are told apart
    named = texts.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("unit"), "doc_id", "text", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("nameless"))
    # rows without doc_id are told apart by their texts, so that they don't all meet in one group
    nameless = texts.where("doc_id is null").withColumn("unit", F.xxhash64("text"))
    units = named.union(nameless.groupBy("unit").agg(F.col("unit").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"), F.lit(True).alias("nameless")))
    some = exploded(units.where(F.pmod(F.xxhash64("unit"), F.lit(every)) == 0), order, np.zeros(0, dtype=np.uint64))
    frequent = some.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").orderBy(F.desc("df"), "h").limit(hot).collect()
    known = np.sort(np.array([r["h"] for r in frequent], dtype=np.int64).view(np.uint64))
    words, known_total = hot_totals(texts, order, known)

    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, bits = max(1, bytes_ // GROUP), min(MOST, (bytes_ // BUCKET).bit_length())
    dealt = units.withColumn("g", F.pmod("unit", F.lit(groups)))
    in_groups = dealt.repartition("g").sortWithinPartitions("g")
    turns = []
    for turn in range(TURNS):
        found = elsewhere(by_bucket(exploded(in_groups, order, known, turn), groups, bits), bits)
        turns.append(work.save(found.select("g", F.lit(turn).alias("turn"), "bucket", "rest"), tidy=True))
    shared = docs.sparkSession.sparkContext.broadcast((known, known_total))

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        rest, _ = _numbers(answers.sort_by([("turn", "ascending"), ("bucket", "ascending")])["rest"], np.int64)
        buf, offsets = tb.buffers(group["text"])
        before, found = grams(buf[offsets[0] : offsets[-1]], offsets - offsets[0], order)
        sums = _scored(before, found, group["copies"].to_numpy(), rest, Hot(shared.value[0]), shared.value[1], words, alpha)
        n = np.diff(before)
        return pa.table([group["doc_id"], group["nameless"], pa.array(n, pa.int64()), pa.array(sums), pa.array(sums / np.maximum(n, 1))], ["doc_id", "nameless", *measures])

    measures = ["n_words", "log_score", "mean_log_score"]
    both = dealt.select("g", "doc_id", "text", "copies", "nameless").groupBy("g").cogroup(reduce(DataFrame.union, turns).groupBy("g"))
    # a table, so that n-grams are counted once for rows with and without doc_id
    scored = work.save(both.applyInArrow(run, "doc_id long, nameless boolean, n_words long, log_score double, mean_log_score double"), tidy=True)
    work.drop(*turns)
    copies = nameless.select(F.col("unit").alias("of"), F.lit(None).cast("long").alias("doc_id"))
    theirs = scored.where("nameless").select(F.col("doc_id").alias("unit"), *measures)
    return scored.where("not nameless").select("doc_id", *measures).union(copies.join(theirs, F.col("of") == F.col("unit")).select("doc_id", *measures))


def _scored(before: np.ndarray, found: list[np.ndarray], copies: np.ndarray, rest: np.ndarray, hot: Hot, totals: np.ndarray, words: int, alpha: float) -> np.ndarray:
    """The log score of each text of a group; ``rest`` are the counts in other groups of the group's n-grams, in the order of their hashes, without those in ``hot``, of which ``totals`` are those of all texts."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    full = [np.flatnonzero(h) for h in found]
    flat, whose = np.concatenate([h[k] for h, k in zip(found, full, strict=True)]), np.concatenate([text[k] for k in full])
    by = _order(flat)
    flat, whose = flat[by], whose[by]
    first, own = _firsts(flat), _firsts(flat, whose)
    total = np.add.reduceat(copies[whose], first) if len(first) else np.zeros(0, dtype=np.int64)
    place = hot.places(flat[first])
    total[place < 0] += rest
    total[place >= 0] = totals[place[place >= 0]]
    own_n = np.diff(np.append(own, len(flat)))
    count = np.empty(len(flat), dtype=np.int64)
    starts = np.zeros(len(flat), dtype=bool)
    starts[first] = True
    count[by] = np.repeat(total[np.cumsum(starts[own]) - 1] - own_n, own_n)  # without the text's own
    others, at = [], 0
    for k in full:
        others.append(np.zeros(len(text), dtype=np.int64))
        others[-1][k] = count[at : at + len(k)]
        at += len(k)
    place = np.arange(len(text)) - before[text]
    log = np.log(np.where(others[0] > 0, others[0], alpha) / np.maximum(words - np.diff(before)[text], 1))
    for k in range(2, len(found) + 1):
        context = np.concatenate(([0], others[k - 2][:-1]))
        here = others[k - 1] > 0
        longer = np.log(np.where(here, others[k - 1], 1) / np.where(here, context, 1))
        log = np.where(place >= k - 1, np.where(here, longer, log + np.log(alpha)), log)
    return np.add.reduceat(np.concatenate((log, [0.0])), np.minimum(before[:-1], len(log))) * (np.diff(before) > 0)
