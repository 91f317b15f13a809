"""Removal of repeated passages, by an enhanced suffix array over sampled suffixes.

A string of ``length`` bytes that occurs twice contains, at the same offset, the same
*anchor*: the k-gram with the least hash of its window (a minimizer).  So suffixes need to be
sorted only from anchors on.  Texts are not shuffled to find anchors that occur more
than once; only those get their context, the bytes before and after them.

All suffixes that start with one anchor are one group.  The group is sorted by the
bytes that follow, and its common-prefix array is scanned with a stack, which yields every
interval of suffixes that share a prefix of r bytes.  In an interval the bytes
before the anchors are compared, to see how far the group extends to the left and
where its members part (the test of left-extension diversity).  Each interval and left extension of ``length`` bytes together
is a maximal repeat with all its occurrences.

Exact copies of whole texts are found by digest first.  Groups of more than
``GROUP`` suffixes are not sorted in one task: the windows that hold the anchor are
counted by hash instead, which is a map-side combined aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: Suffixes of one anchor that are sorted in one task, at most.
GROUP = 50_000


def _anchor_length(length: int) -> int:
    return max(1, length // 4)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``buf`` and hashes of the anchors of all windows of ``length`` bytes that lie within a text."""
    k = _anchor_length(length)
    w = length - k + 1
    n = len(buf)
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    sums = tb.prefix_sums(buf)
    at = np.arange(n - k + 1)
    h = tb.span_hashes(sums, at, at + k)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    rows = -(-len(key) // w)
    key = np.concatenate((key, np.full(rows * w - len(key), np.iinfo(np.uint64).max)))
    ahead = np.minimum.accumulate(key.reshape(rows, w), axis=1).ravel()
    back = np.minimum.accumulate(key.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], ahead[w - 1 : w - 1 + n - length + 1])
    inside = np.ones(n - length + 1, dtype=bool)
    for end in offsets[1:-1]:  # windows that would cross into the next text
        inside[max(0, end - length + 1) : end] = False
    chosen = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(chosen):
        chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return chosen, h[chosen]


def text_anchors(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, bytes and sha-256 of each text, and the hashes of its anchors, each with the number of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, hashes, many = [], [], [], []
            for first, end, buf, offsets in tb.chunks(batch.column(1)):
                at, h = anchors(buf, offsets, length)
                cut = np.searchsorted(at, offsets)
                raw = buf.tobytes()
                for i in range(end - first):
                    size.append(int(offsets[i + 1] - offsets[i]))
                    sha.append(hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).hexdigest())
                    each, n = np.unique(h[cut[i] : cut[i + 1]], return_counts=True)
                    hashes.append(each)
                    many.append(n)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in hashes]))), pa.int32())
            h = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, dtype=np.int64)
            m = np.concatenate(many) if many else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(m, pa.int32()))], ["doc_id", "n_bytes", "sha", "h", "m"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, sha string, h array<long>, m array<int>")


def _fixed(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


_CONTEXT = "h long, n long, doc long, at long, la long, ra long, before binary, after binary"


def contexts(marked: DataFrame, length: int) -> DataFrame:
    """A row for each place of a marked anchor: the bytes before it, nearest first, those from it on, and how many there are.

    Contexts that are equal within a text, as in runs of one line, are one row; every place
    of such a context is a further row with n = -1 and no bytes.
    """
    before, after = length - _anchor_length(length), length
    span = np.arange(-before, after)

    def rows(h: np.ndarray, n: int, doc: int, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        return h, np.full(len(at), n), np.full(len(at), doc), at, np.minimum(at, before), np.minimum(size - at, after)

    def batch_of(ids: list, part: list | None) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate([x[k] for x in ids]), pa.int64()) for k in range(6)]
        if part is None:
            cols += [pa.array([b""] * len(cols[0]), pa.binary())] * 2
        else:
            ctx = np.concatenate(part)
            cols += [_fixed(ctx[:, :before][:, ::-1]), _fixed(ctx[:, before:])]
        return pa.RecordBatch.from_arrays(cols, ["h", "n", "doc", "at", "la", "ra", "before", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, offsets = tb.buffers(batch.column(1))
            docs = batch.column(0).to_pylist()
            marks = batch.column(2)
            cut = marks.offsets.to_numpy().astype(np.int64)
            marked_h = marks.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ids, part, places, used = [], [], [], 0
            for i, doc in enumerate(docs):
                text = texts[offsets[i] : offsets[i + 1]]
                at, h = anchors(text, np.array([0, len(text)]), length)
                mine = np.isin(h, marked_h[cut[i] : cut[i + 1]])
                at, h = at[mine], h[mine].view(np.int64)
                order = np.lexsort((at, h))
                at, h = at[order], h[order]
                padded = np.concatenate((np.zeros(before, np.uint8), text, np.zeros(after, np.uint8)))
                same = np.zeros(len(h), dtype=bool)
                same[1:] = h[1:] == h[:-1]
                twin = same.copy()
                twin[:-1] |= same[1:]
                if twin.any():
                    seen: dict[tuple, list[int]] = {}
                    for k in np.flatnonzero(twin):
                        p = int(at[k])
                        seen.setdefault((int(h[k]), min(p, before), min(len(text) - p, after), padded[p : p + before + after].tobytes()), []).append(int(k))
                    repeated = [k for ks in seen.values() if len(ks) > 1 for k in ks]
                    if repeated:
                        places.append(rows(h[repeated], -1, doc, at[repeated], len(text)))
                        keep = np.ones(len(h), dtype=bool)
                        keep[[k for ks in seen.values() for k in ks[1:]]] = False
                        h, at = h[keep], at[keep]
                for k in range(0, len(at), 20_000):
                    some = at[k : k + 20_000]
                    part.append(padded[some[:, None] + before + span])
                    ids.append(rows(h[k : k + 20_000], 1, doc, some, len(text)))
                    used += len(some)
                    if used > 20_000:
                        yield batch_of(ids, part)
                        ids, part, used = [], [], 0
            if ids:
                yield batch_of(ids, part)
            if places:
                yield batch_of(places, None)

    return marked.mapInArrow(run, _CONTEXT)


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``most``."""
    differs = x != y
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])
    return np.minimum(first, most)


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(r, first, last) of every interval of sorted suffixes that share exactly r bytes; lcp[i] is that of i - 1 and i."""
    stack = [(0, 0)]  # (r, first)
    n = len(lcp)
    for i in range(1, n + 1):
        r, first = (int(lcp[i]) if i < n else 0), i - 1
        while stack[-1][0] > r:
            deep, first = stack.pop()
            yield deep, first, i - 1
        if stack[-1][0] < r:
            stack.append((r, first))


def repeats(before: np.ndarray, after: np.ndarray, la: np.ndarray, ra: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeats of ``length`` bytes or more among suffixes with one anchor.

    Each is (members in order of what precedes them, common bytes before the anchor of each and the next one, bytes from the anchor on).
    """
    order = np.argsort(np.ascontiguousarray(after).view(f"S{after.shape[1]}").ravel(), kind="stable")
    sorted_ = after[order]
    lcp = np.concatenate(([0], _common(sorted_[1:], sorted_[:-1], np.minimum(ra[order][1:], ra[order][:-1]))))
    rank = np.empty(len(order), dtype=np.int64)
    rank[np.argsort(np.ascontiguousarray(before).view(f"S{before.shape[1]}").ravel(), kind="stable")] = np.arange(len(order))
    for r, first, last in intervals(lcp):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        left = _common(before[members[1:]], before[members[:-1]], np.minimum(la[members[1:]], la[members[:-1]]))
        if (left + r >= length).any():
            yield members, left, r


def _reach(before: np.ndarray, after: np.ndarray, la: np.ndarray, ra: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated windows reach before and after each anchor; -1 where there is none."""
    far, on = np.full(len(la), -1, dtype=np.int64), np.full(len(la), -1, dtype=np.int64)
    for members, left, r in repeats(before, after, la, ra, length):
        good = left + r >= length
        for side in (members[1:][good], members[:-1][good]):
            np.maximum.at(far, side, left[good])
            np.maximum.at(on, side, r)
    return far, on


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """h, doc, at, la, ra and the matrices before and after."""
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4, 5)]
    for k in (6, 7):
        data, ends = tb.buffers(batch.column(k))
        cols.append(data[ends[0] : ends[-1]].reshape(batch.num_rows, -1))
    return tuple(cols)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole anchor groups, many at a time, as ``_columns`` has them."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        now = cols if kept is None else tuple(np.concatenate(x) for x in zip(kept, cols, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1], side="left")) if len(now[0]) else 0
        if cut:
            yield tuple(x[:cut] for x in now)
        kept = tuple(x[cut:] for x in now)
    if kept is not None and len(kept[0]):
        yield kept


def _spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, at, la, ra, before, after in _groups(batches):
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.concatenate((start, [len(h)])))
            far, on = np.full(len(h), -1, dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
            a = start[size == 2]
            left = _common(before[a], before[a + 1], np.minimum(la[a], la[a + 1]))
            right = _common(after[a], after[a + 1], np.minimum(ra[a], ra[a + 1]))
            good = left + right >= length
            for k in (a[good], a[good] + 1):
                far[k], on[k] = left[good], right[good]
            for s, m in zip(start[size > 2], size[size > 2], strict=True):
                e = s + m
                far[s:e], on[s:e] = _reach(before[s:e], after[s:e], la[s:e], ra[s:e], length)
            hit = far >= 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((at - far)[hit]), pa.array((at + on)[hit])], ["doc", "start", "end"])

    return run


def _occurrences(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, at, la, ra, before, after in _groups(batches):
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ids, docs, starts, sizes = [], [], [], []
            for s, e in zip(start, np.concatenate((start[1:], [len(h)])), strict=True):
                for n, (members, left, r) in enumerate(repeats(before[s:e], after[s:e], la[s:e], ra[s:e], length)):
                    for common, i, j in intervals(np.concatenate(([0], left))):
                        some = s + members[i : j + 1]
                        longest = int(ra[some].min())
                        # if all go on in the same way, a longer repeat has them
                        if common + r >= length and not (longest > r and (after[some, r] == after[some[0], r]).all()):
                            ids += [f"{int(h[s]) & 0xFFFFFFFFFFFFFFFF:016x}.{n}.{common}.{i}"] * len(some)
                            docs.append(doc[some])
                            starts.append(at[some] - common)
                            sizes.append(np.full(len(some), common + r))
            cols = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (docs, starts, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(c, pa.int64()) for c in cols]], ["repeat_id", "doc_id", "start", "length"])

    return run


def _windows(length: int):
    """Hashes of all windows around an anchor, for groups that are too large to be sorted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, at, la, ra, before, after in map(_columns, (b for b in batches if b.num_rows)):
            text = np.concatenate((before[:, ::-1], after), axis=1)
            width, reach = text.shape[1], before.shape[1]
            flat = np.ascontiguousarray(text).ravel()
            for k in range(0, len(h), 2000):
                rows = np.arange(k, min(k + 2000, len(h)))
                sums = tb.prefix_sums(flat[rows[0] * width : (rows[-1] + 1) * width])
                base = (rows - k) * width + reach
                found = [np.zeros((0, 4), dtype=np.int64)]
                for back in range(reach + 1):
                    ok = (la[rows] >= back) & (ra[rows] >= length - back)
                    w = tb.mix(tb.span_hashes(sums, base[ok] - back, base[ok] - back + length) + tb.mix(h[rows][ok].view(np.uint64) + np.uint64(back))).view(np.int64)
                    found.append(np.stack((w, doc[rows][ok], at[rows][ok], np.full(ok.sum(), back)), axis=1))
                all_ = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(all_[:, c]) for c in range(4)], ["w", "doc", "at", "back"])

    return run


def _repeated_contexts(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Contexts of the anchors that occur more than once, exact copies of a text taken once."""
    reps = found.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    filed = found.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), F.explode(F.arrays_zip("h", "m")).alias("x")).select("doc", F.col("x.h").alias("h"), F.col("x.m").alias("m"))
    # as a table of its own, so that Spark can split the join where one anchor is in many texts
    shared = work.save(filed.groupBy("h").agg(F.sum("m").alias("m")).where("m > 1").select("h"))
    marks = filed.join(shared, "h").groupBy("doc").agg(F.collect_list("h").alias("marks"))
    marked = texts.join(marks.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id")
    return contexts(marked.select("doc_id", "text", "marks"), length)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _large(rows: DataFrame) -> DataFrame:
    """Anchors of more than ``GROUP`` different contexts."""
    return rows.where("n > 0").groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("h")


def _repeated_windows(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """``w, doc, at, back`` of all windows of ``length`` bytes around the anchors of ``rows``, and those ``w`` that occur more than once."""
    large = rows.mapInArrow(_windows(length), "w long, doc long, at long, back long")
    return large, large.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")


def maximal_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``repeat_id, doc_id, start, length`` of all occurrences of every maximal repeat, within the reach of its anchor.

    Of exact copies of a whole text only the one with the smallest doc_id takes part, and of equal contexts
    within a text the first. Around anchors of more than ``GROUP`` contexts every repeated window of ``length`` bytes is
    a repeat of its own, so no occurrence is left out there either. Rows without doc_id are left out.
    """
    texts = _texts(docs)
    rows = work.save(_repeated_contexts(texts, work.save(text_anchors(texts, length)), length)).where("n > 0")
    usual = rows.join(_large(rows), "h", "left_anti").select(rows.columns).repartition("h").sortWithinPartitions("h").mapInArrow(_occurrences(length), "repeat_id string, doc_id long, start long, length long")
    windows, again = _repeated_windows(rows.join(_large(rows), "h", "left_semi").select(rows.columns), length)
    large = windows.join(again, "w").select(F.concat(F.lit("w"), F.lower(F.hex("w"))).alias("repeat_id"), F.col("doc").alias("doc_id"), F.expr("at - back").alias("start"), F.lit(length).cast("long").alias("length"))
    return usual.union(large.distinct())


def repeated_spans(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``doc_id, n_bytes, sha, copies`` of every row, and ``doc_id, spans`` of the texts that have repeated bytes.

    ``spans`` lists (start, end) of repeated stretches, which may overlap; exact copies of a whole text have none
    listed, their ``copies`` (over 1) says that all of it is repeated if it has ``length`` bytes.
    """
    texts = _texts(docs)
    found = work.save(text_anchors(texts, length))
    copies = found.groupBy("sha").agg(F.count("*").alias("copies"))
    rows = work.save(_repeated_contexts(texts, found, length))
    large_groups = _large(rows)
    within = rows.where("n < 0").where(F.col("la") + F.col("ra") >= length).select("doc", F.expr("at - la").alias("start"), F.expr("at + ra").alias("end"))
    usual = rows.where("n > 0").join(large_groups, "h", "left_anti").select(rows.columns).repartition("h").sortWithinPartitions("h").mapInArrow(_spans(length), "doc long, start long, end long").union(within)
    seen = rows.where("n > 0").join(large_groups, "h", "left_semi").select(rows.columns)
    if seen.isEmpty():
        spans = usual
    else:
        large, again = _repeated_windows(seen, length)
        reach = large.join(again, "w", "left_semi").groupBy("doc", "at").agg(F.max("back").alias("hi"), F.min("back").alias("lo"))
        spans = usual.union(reach.select("doc", F.expr("at - hi"), F.expr(f"at - lo + {length}")))
    spans = work.save(spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    work.drop(rows)
    return found.join(copies, "sha").select("doc_id", "n_bytes", "sha", "copies"), spans


def merge(spans: list) -> tuple[list[int], list[int]]:
    """The maximal stretches that the spans cover together."""
    starts, ends = [], []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.buffers(batch.column(1))
        removed, count, sha, kept = [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            starts, ends = merge(spans)
            left = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))
            removed.append(len(text) - len(left))
            count.append(len(starts))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_removed, n_spans, kept_sha256, kept`` of the texts that have repeated spans; ``kept`` is binary."""
    return _texts(docs).join(spans.hint("shuffle_hash"), "doc_id").mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    Every byte of a text that is covered by a string of ``length`` bytes that also starts anywhere
    else, in the same text or another, is removed; all of them, the first occurrence too. Strings are judged on
    the input. A null text is empty; texts of fewer than ``length`` bytes stay whole. doc_id is unique, but repeated equal rows
    count as copies of each other. A row without doc_id is matched as a whole text only: it loses all its bytes if another text equals it, else none. Columns other than doc_id and text are ignored.
    """
    rows, spans = repeated_spans(docs, length)
    cut = cut_repeats(docs, spans).drop("kept")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(cut.dropDuplicates(["doc_id"]), "doc_id", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes of their texts removed, and ``n_chars`` set anew if there is such a column.

    Bytes of a character that is cut in two are dropped, so that texts stay valid. A null text stays null.
    """
    rows, spans = repeated_spans(docs, length)
    whole = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans")).dropDuplicates(["doc_id"])
    spans = spans.join(whole, "doc_id", "left_anti").union(whole)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for text, mine in zip(texts, batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                starts, ends = merge(mine)
                out.append(b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *[batch.column(k) for k in range(2, batch.num_columns)]], ["text", *others])

    others = [c for c in docs.columns if c != "text"]
    marked = docs.join(spans.withColumnRenamed("spans", "__spans").hint("shuffle_hash"), "doc_id", "left")
    touched = marked.where("__spans is not null and text is not null").select("text", "__spans", *others)
    schema = "text string, " + ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    out = touched.mapInArrow(cut, schema).select(docs.columns).union(marked.where("__spans is null or text is null").select(docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
