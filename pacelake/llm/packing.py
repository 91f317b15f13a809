"""Packing of tokenized documents into sequences by bounded-space online best-fit.

A task tokenizes texts and cuts those over the capacity into pieces; equal words, or parts of them that
are tokenized alike wherever they stand, are tokenized once.  Then each task takes its pieces in turn: a fixed number of bins is open, a bitset
tells which amounts of free space occur, and a piece goes where the least space stays free.
Where too many bins are open, the fullest closes.

What a task leaves open at its end is packed again by fewer tasks, each of which gets the open bins of
``FAN`` tasks, until one task holds all that is left, which is never more than ``FAN`` times the open bins
of a task; that one takes pieces by descending length and closes none early.  Rounds are jobs from table to table, so a
task that is run again can't part pieces from their sequence.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: Tokens of a sequence, at most.
CAPACITY = 2048
#: The token after each document.
END = 0
#: Bins that a task holds open.
OPEN = 1024
#: Tasks whose open bins one task of the next round gets.
FAN = 16
#: Bytes of text that are tokenized at once; longer texts are taken in parts of whole words.
CHUNK = 4 << 20
#: Words whose ids a task remembers.
WORDS = 1 << 20
#: Words that are tokenized as one text.
JOINED = 10_000
#: Rows of a batch that a task returns.
BATCH = 10_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What a byte is: 0 white space, 1 a letter A-Z or a-z, 2 a digit, 3 another sign, 4 any that may belong with its neighbours.
_KIND = np.array([0 if space else 4 if i > 127 or chr(i) in "'<|>" else 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3 for i, space in enumerate(tb.IS_SPACE)], dtype=np.uint8)


def _parted(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every part of a word that is tokenized alike wherever it stands, and the number of parts before each text.

    Words end at white space; within them ASCII letters, single digits and other ASCII signs part from each other, but for signs of contractions and special tokens.
    """
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    kind = _KIND[buf]
    opens = kind > 0
    new = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    opens[1:] &= (kind[:-1] == 0) | (new & (kind[1:] < 4) & (kind[:-1] < 4))
    first = offsets[1:-1]
    first = first[first < len(buf)]
    opens[first] = kind[first] > 0
    closes = kind > 0
    closes[:-1] &= (kind[1:] == 0) | opens[1:]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets)


class Words:
    """The ids of parts of words, each tokenized once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.final = np.zeros(max(self.model.get_vocab().values()) + 1, dtype=bool)
        self.final[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.ends, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number of words of ASCII letters only: joined by spaces, the last token of each is marked as such."""
        found = self.model.encode_batch_fast([" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found]) if found else np.zeros(0, dtype=np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else None

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)

    def _learn(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = buf.tobytes()
        other = np.concatenate(([0], np.cumsum(_KIND[buf] != 1)))
        plain = other[end] == other[start]
        for some, take in ((np.flatnonzero(plain), self._letters), (np.flatnonzero(~plain), self._singly)):
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[some].tolist(), end[some].tolist())]
            if words:
                ids, sizes = take(words) or self._singly(words)
                self.hashes, self.place = np.concatenate((self.hashes, h[some])), np.concatenate((self.place, len(self.ends) - 1 + np.arange(len(words))))
                self.flat, self.ends = np.concatenate((self.flat, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        order = np.argsort(self.hashes)
        self.hashes, self.place = self.hashes[order], self.place[order]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each text end (with a 0 in front)."""
        start, end, before = _parted(buf, offsets)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        h, first, which = np.unique(tb.span_hashes(tb.prefix_sums(buf), start, end), return_index=True, return_inverse=True)
        if len(self.hashes) > WORDS:
            self._forget()
        new = ~np.isin(h, self.hashes, assume_unique=True)
        if new.any():
            self._learn(h[new], buf, start[first[new]], end[first[new]])
        word = self.place[np.searchsorted(self.hashes, h)][which]
        size = self.ends[word + 1] - self.ends[word]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.repeat(self.ends[word] - ends[:-1], size) + np.arange(ends[-1])], ends[before]


def _parts(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about ``CHUNK`` bytes that end at white space."""
    at = 0
    while at < len(buf):
        end = at + CHUNK
        if end < len(buf):
            gap = np.flatnonzero(tb.IS_SPACE[buf[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < len(buf) and not tb.IS_SPACE[buf[end]]:
                    end += 1
        yield buf[at:end]
        at = end


def _cut(words: Words, column: pa.Array, capacity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, piece, start, ids, offsets of the pieces in them) of some rows at a time."""
    for first, end, buf, offsets in tb.chunks(column, CHUNK):
        if len(buf) <= CHUNK:
            ids, ends = words.ids(buf, offsets)
            closed = np.insert(ids, ends[1:], END)
            ends = ends + np.arange(len(ends))
            tokens = np.diff(ends)
            count = -(-tokens // capacity)
            row = np.repeat(np.arange(first, end), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            cuts = np.repeat(ends[:-1], count) + start
            yield row, piece, start, closed, np.append(cuts, ends[-1])
            continue
        held, done = np.zeros(0, dtype=np.uint32), 0  # a text longer than a chunk is alone in its own
        for part in (*_parts(buf), None):
            fresh = np.array([END], dtype=np.uint32) if part is None else words.ids(part, np.array([0, len(part)]))[0]
            held = np.concatenate((held, fresh))
            count = -(-len(held) // capacity) if part is None else len(held) // capacity
            cuts = np.minimum(np.arange(count + 1) * capacity, len(held))
            piece = done + np.arange(count)
            yield np.full(count, first), piece, piece * capacity, held[: cuts[-1]], cuts
            held, done = held[cuts[-1] :], done + count


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for: the ids of each text and a closing 0, cut into pieces of ``capacity``.

    ``path`` is a file of the tokenizers library that parts words as ``word_bpe_49k.json`` does: at white space, and between letters, digits and other signs. A null text counts as empty, which is one piece with the closing 0 only.
    Rows with a null doc_id, and repeated ones, are cut like others. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for batch in batches:
            for row, piece, start, ids, cuts in _cut(words, batch.column(1), capacity):
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                made = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                if keep_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                for at in range(0, len(row), BATCH):
                    yield pa.RecordBatch.from_arrays([c.slice(at, BATCH) for c in made], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _PIECE + ", ids array<int>" * keep_ids)


class Bins:
    """Open bins by free space. ``put`` returns the rows of the bins that have closed, each with its bin and offset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.bits = 0
        self.by_free: list[list] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def put(self, row: tuple, size: int, closed: list) -> None:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number, rows = self._take(free)
        else:
            free, number, rows = self.capacity, self.made, []
            self.made += 1
        rows.append((*row, number, self.capacity - free, False))
        free -= size
        if not free:
            closed += rows
            return
        self.by_free[free].append((number, rows))
        self.bits |= 1 << free
        self.count += 1
        if self.count > self.most:
            closed += self._take((self.bits & -self.bits).bit_length() - 1)[1]

    def rest(self, open_: bool) -> Iterator[tuple]:
        for bins in self.by_free:
            for _, rows in bins:
                for row in rows:
                    yield (*row[:-1], open_)


def _pack(pieces: DataFrame, turn: int, capacity: int, most: int, last: bool) -> DataFrame:
    """One round over the partitions of ``pieces``: adds ``sequence_id``, ``offset`` and ``open``."""
    columns = pieces.columns
    size_at = columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, names, types = Bins(capacity, most), None, None
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols[-3] = [base + n for n in cols[-3]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def rows_of() -> Iterator[tuple]:
            nonlocal names, types
            for batch in batches:
                names = [*columns, "sequence_id", "offset", "open"]
                types = [*batch.schema.types, pa.int64(), pa.int64(), pa.bool_()]
                yield from zip(*(batch.column(i).to_pylist() for i in range(len(columns))))

        closed: list = []
        for row in sorted(rows_of(), key=lambda r: -r[size_at]) if last else rows_of():
            bins.put(row, row[size_at], closed)
            if len(closed) >= BATCH:
                yield batch_of(closed)
                closed = []
        for row in bins.rest(not last):
            closed.append(row)
            if len(closed) >= BATCH:
                yield batch_of(closed)
                closed = []
        if closed:
            yield batch_of(closed)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, kinds + ", sequence_id long, `offset` long, open boolean")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, fan: int = FAN) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``: no sequence is over the capacity, offsets leave no gap.

    Equal rows are packed one by one; without rows the result is empty. ``pieces`` may have other columns of numbers, texts or lists.
    """
    rounds, turn, left, tasks = [], 0, pieces, 0
    while True:
        last = tasks == 1
        done = work.save(_pack(left.coalesce(tasks) if tasks else left, turn, capacity, fan * open_bins if last else open_bins, last))
        rounds.append(done.where("not open").drop("open"))
        if last:
            return reduce(DataFrame.union, rounds)
        left = done.where("open").drop("open", "sequence_id", "offset")
        tasks = max(1, -(-done.where("open and `offset` = 0").count() // (fan * open_bins)))
        turn += 1


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for) of every piece of every row of ``docs``.

    See ``token_pieces`` for what becomes of odd rows, ``pack_pieces`` for the packing.
    """
    pieces = work.save(token_pieces(docs, path, capacity, keep_ids))
    return pack_pieces(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids`` of each sequence of a table of ``pack`` with ids; no list is longer than the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    each = packed.groupBy("sequence_id").agg(F.sum("length").cast("long").alias("n_tokens"), parts.alias("parts"))
    return each.select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
