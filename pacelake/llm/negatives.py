"""Hard negatives by distributed radix selection.

A row's score for an anchor is an integer inner product. Each anchor and positive span a window of scores, and
what is wanted are the first k rows of another label in it. No task can sort them, so the kth score is located
digit by digit: tasks score their rows and count, for each window, how many fall in each bucket of the open interval; Spark sums the counts;
the bucket that holds the kth row is the next open interval. Where one score is left that more than k rows share,
the digits of ids follow. Then only rows at or above the located key are gathered.
The positives of an anchor, its first rows of the same label, are found the same way, in a window without bounds.

Rows are packed into blocks, anchors into groups of a fixed number, and each block meets each group in one task, which
holds the two and a slice of their products. A task counts only its first rows of a window, as many as can matter: whoever stands
behind them can't be among the first k of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work

#: Components are counted in units of 1 / SCALE.
SCALE = 256
#: Bits of a digit.
DIGIT = 8
#: Rows beyond the kth that may be gathered before the next digit is worth a pass.
SLACK = 32
#: Anchors of a group, about.
ANCHORS = 512
#: Bytes of vectors in a block, and rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Counts that a task adds up before it passes them on.
COUNTS = 1 << 20
#: Products that a task holds.
PRODUCTS = 1 << 20

#: Scores beyond this, either way, count as this.
MOST = (1 << 62) - 1
#: Bytes of anchors that are sent to all tasks; more are joined.
BROADCAST = 16 << 20

_BLOCK = "width int, n int, wide boolean, peak double, first long, last long, ids binary, labels binary, flags binary, vectors binary"


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as doubles where these are whole and exact, else as Python integers."""
    if not x.size or np.abs(x).max() < 2.0**44:
        return np.floor(x * float(SCALE))
    return np.array([int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in exact integers, out of range ones at the end of the range."""
    if x.dtype != object and y.dtype != object:
        bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
        if bound < 2.0**53:
            return (x @ y.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape) @ np.array([[int(v) for v in row] for row in y], dtype=object).reshape(y.shape).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()), np.asarray(column.offsets) - column.offsets[0].as_py()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one width. Vectors are kept as 16-bit integers if they fit, else (``wide``) as they came."""
    names = ["width", "n", "wide", "peak", "first", "last", "ids", "labels", "flags", "vectors"]
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    held: dict[int, list] = {}

    def block(width: int) -> pa.RecordBatch:
        parts = held.pop(width)
        ids, labels, flags = (np.concatenate([p[k] for p in parts]) for k in range(3))
        x = np.concatenate([p[3] for p in parts])
        small = not x.size or np.abs(x).max() < 2.0**14 / SCALE
        data = np.floor(x * float(SCALE)).astype("<i2") if small else x.astype("<f8")
        peak = float(np.abs(x).max(initial=0)) * SCALE + 1
        cells = [width, len(ids), not small, peak, int(ids.min()), int(ids.max()), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), flags.astype("?").tobytes(), data.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

    for batch in batches:
        ids, labels, flags = (np.asarray(batch.column(k)) for k in range(3))
        flat, ends = _lists(batch.column(3))
        flat, sizes = flat.astype(np.float64), np.diff(ends)
        for width in np.unique(sizes).tolist():
            limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * width)))
            rows = np.flatnonzero(sizes == width)
            while len(rows):
                parts = held.setdefault(width, [])
                some, rows = rows[: limit - sum(len(p[0]) for p in parts)], rows[limit - sum(len(p[0]) for p in parts) :]
                parts.append((ids[some], labels[some], flags[some], flat[ends[some][:, None] + np.arange(width)]))
                if sum(len(p[0]) for p in parts) >= limit:
                    yield block(width)
    for width in list(held):
        yield block(width)


def _vectors(width: int, n: int, wide: bool, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype="<f8" if wide else "<i2").reshape(n, width)
    return _whole(x) if wide else x.astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = (np.frombuffer(row[k], dtype="<i8") for k in ("ids", "labels"))
            yield row, ids, labels, np.frombuffer(row["flags"], dtype="?"), _vectors(row["width"], row["n"], row["wide"], row["vectors"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks, one row each, with their own block of one."""
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(row["flags"], dtype="?"))
            if len(at):
                size = len(row["vectors"]) // row["n"]
                ids, labels = (np.frombuffer(row[k], dtype="<i8")[at] for k in ("ids", "labels"))
                raw = [row["vectors"][i * size : (i + 1) * size] for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array([row["width"]] * len(at), pa.int32()), pa.array([row["wide"]] * len(at)), pa.array(raw, pa.binary())], ["anchor_id", "label", "width", "wide", "vector"])


def _columns(group: list[dict], x_width: int) -> tuple[list[int], np.ndarray]:
    """The anchors of a group that have the width, and their vectors."""
    own = [i for i, a in enumerate(group) if a["width"] == x_width]
    return own, np.array([_vectors(x_width, 1, group[i]["wide"], group[i]["vector"])[0] for i in own]).reshape(len(own), x_width)


def _scored(batches: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(window, scores, ids) of the rows that may stand in a window: other rows of the anchor's label, or rows of another."""
    for row, ids, labels, _, x in _blocks(batches):
        own, y = _columns(row["group"], row["width"])
        step = max(1, PRODUCTS // max(1, len(x)))
        for at in range(0, len(own), step):
            scores = _products(y[at : at + step], x)
            for k, line in zip(own[at : at + step], scores):
                anchor = row["group"][k]
                fits = (labels == anchor["label"]) & (ids != anchor["anchor_id"]) if same else labels != anchor["label"]
                line, found = line[fits], ids[fits]
                if not len(line):
                    continue
                order = np.argsort(-line, kind="stable")
                line, found = line[order], found[order]
                for w in anchor["windows"]:
                    # scores descend: those in the open interval are one slice
                    first, end = np.searchsorted(-line, -w["high"], side="left"), np.searchsorted(-line, -w["low"], side="right")
                    if first < end:
                        yield w, line[first:end], found[first:end]


def _summed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(window, digit, n) with the counts of several blocks added up before they leave the task."""
    held, size = [], 0

    def total() -> tuple:
        window, digit, n = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((digit, window))
        window, digit, n = window[order], digit[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1]) | (digit[1:] != digit[:-1]))))
        return window[new], digit[new], np.add.reduceat(n, new)

    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= COUNTS:
            held = [total()]
            size = len(held[0][0])
            if size >= COUNTS // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield total()


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrays of equal length, some thousand rows at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def _histograms(same: bool):
    """Counts by bucket of the open interval of each window: of scores, or where one score is left, of ids."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for w, score, ids in _scored(batches, same):
            if w["by_id"]:
                bucket = np.sort(ids[(ids >= w["id_low"]) & (ids <= w["id_high"])]) >> w["id_shift"]
            else:
                bucket = (w["high"] - score) >> max(0, (w["high"] - w["low"]).bit_length() - DIGIT)
            digit, n = np.unique(bucket[: w["need"] + SLACK + 1], return_counts=True)
            yield np.full(len(digit), w["window"]), digit, n.astype(np.int64)

    return lambda batches: _batches(_summed(counts(batches)), ["window", "digit", "n"])


def _members(same: bool):
    """Rows of each window that stand at or above its key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for w, score, ids in _scored(batches, same):
            keep = (score > w["low"]) | (ids <= w["id_high"])
            yield np.full(int(keep.sum()), w["window"]), ids[keep], score[keep]

    return lambda batches: _batches(rows(batches), ["window", "id", "score"])


class _Rows:
    """The packed rows of a search, and its anchors in groups."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        bounds = blocks.agg(F.max("peak"), F.max("width"), F.min("first"), F.max("last")).first()
        peak, width, first, last = bounds if bounds[1] is not None else (0.0, 0, 0, 0)
        self.bound = min(MOST, int(min(peak, 1e18)) ** 2 * max(1, width))
        self.first, self.last = first, last
        self.id_shift = max(0, (first ^ last).bit_length() - DIGIT) if (first < 0) == (last < 0) else 64 - DIGIT
        self.anchors = work.save(blocks.mapInArrow(_anchors, "anchor_id long, label long, width int, wide boolean, vector binary"))
        found = self.anchors.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))).first()
        self.groups = max(1, -(-found[0] // ANCHORS))
        self.bytes = found[1] + 1000 * found[0]

    def meet(self, windows: DataFrame) -> DataFrame:
        """Every block beside every group of the anchors that have windows."""
        state = F.struct("window", "high", "low", "need", "by_id", "id_low", "id_high", "id_shift")
        by_anchor = windows.groupBy("anchor_id").agg(F.collect_list(state).alias("windows"))
        one = F.struct("anchor_id", "label", "width", "wide", "vector", "windows")
        at = F.pmod(F.xxhash64("anchor_id"), F.lit(self.groups)).cast("int")
        groups = self.anchors.join(by_anchor, "anchor_id").groupBy(at.alias("at")).agg(F.collect_list(one).alias("group"))
        dealt = self.blocks.select("width", "n", "wide", "ids", "labels", "flags", "vectors", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("at"))
        return dealt.join(F.broadcast(groups) if self.bytes <= BROADCAST else groups, "at").drop("at")

    def first_rows(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """``window, id, score, rank`` of the first k rows of each of the ``windows`` (``window, anchor_id, high, low``)."""
        ids = {"id_low": F.lit(self.first).cast("long"), "id_high": F.lit(self.last).cast("long"), "id_shift": F.lit(self.id_shift)}
        state = work.save(windows.select("window", "anchor_id", F.col("high").alias("top"), "high", "low").withColumns({"need": F.lit(k), "by_id": F.lit(False), **ids, "open": F.lit(True)}))
        while not state.where("open").isEmpty():
            old = state
            counts = self.meet(state.where("open")).mapInArrow(_histograms(same), "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
            hit = counts.withColumn("upto", upto).join(state.select("window", "need"), "window").where("upto >= need").groupBy("window").agg(F.min_by(F.struct("digit", "n", "upto"), "digit").alias("hit"))
            state = work.save(_narrowed(state.join(hit, "window", "left")))
            work.drop(old)
        found = self.meet(state.withColumn("high", F.col("top"))).mapInArrow(_members(same), "window long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
        out = work.save(found.withColumn("rank", rank).where(F.col("rank") <= k))
        work.drop(state)
        return out


def _narrowed(state: DataFrame) -> DataFrame:
    """The next open interval of each open window: the bucket ``hit``. Closed are windows that few more rows than wanted reach, or that have no more rows than that."""
    bits = f"greatest(0, length(bin(high - low)) - {DIGIT})"
    new = state.withColumns({"new_high": F.expr(f"high - shiftleft(hit.digit, {bits})"), "id_first": F.expr("shiftleft(hit.digit, id_shift)")})
    new = new.withColumns({"new_low": F.expr(f"greatest(low, new_high - shiftleft(1L, {bits}) + 1)"), "enough": F.expr(f"hit.upto <= need + {SLACK}")})
    by_score, by_id = "open AND NOT by_id AND hit IS NOT NULL", "open AND by_id AND hit IS NOT NULL"
    one = "new_high = new_low"
    return new.select(
        "window", "anchor_id", "top",
        F.expr(f"CASE WHEN {by_score} THEN new_high ELSE high END").alias("high"),
        F.expr(f"CASE WHEN {by_score} THEN new_low ELSE low END").alias("low"),
        F.expr("CASE WHEN open AND hit IS NOT NULL THEN CAST(need - hit.upto + hit.n AS INT) ELSE need END").alias("need"),
        F.expr(f"by_id OR coalesce({by_score} AND {one} AND NOT enough, false)").alias("by_id"),
        F.expr(f"CASE WHEN {by_id} THEN greatest(id_low, id_first) ELSE id_low END").alias("id_low"),
        F.expr(f"CASE WHEN {by_id} THEN least(id_high, id_first + shiftleft(1L, id_shift) - 1) ELSE id_high END").alias("id_high"),
        F.expr(f"CASE WHEN {by_id} THEN greatest(0, id_shift - {DIGIT}) ELSE id_shift END").alias("id_shift"),
        F.expr("open AND hit IS NOT NULL AND NOT enough AND NOT (by_id AND id_shift = 0)").alias("open"),
    )


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows`` (``vec_id, embedding, label, is_anchor``).

    A score is the inner product of floor(256 * component). An anchor's positives are the first of its label by score, then vec_id; for each,
    its negatives are the first rows of another label whose score is ``low`` to ``high`` tenths of the positive's.

    Rows with a null in vec_id, label, vector or component, or with a component that isn't finite, take no part. Of several rows of one vec_id the first by label, then by
    vector counts. Vectors of different lengths aren't compared; scores beyond 2**62 count as that. An anchor without positives, and a positive
    without negatives, return no row; so do empty tables. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"), F.coalesce(F.col("is_anchor"), F.lit(False)).alias("is_anchor"))
    clean = clean.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    one = clean.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "is_anchor")).alias("one")).select("vec_id", "one.label", "one.is_anchor", "one.embedding")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _Rows(work.save(one.mapInArrow(_pack, _BLOCK).repartition(tasks, F.xxhash64("ids"))))

    whole = found.anchors.select(F.col("anchor_id").alias("window"), "anchor_id", F.lit(found.bound).cast("long").alias("high"), F.lit(-found.bound).cast("long").alias("low"))
    first = found.first_rows(whole, positives, True)
    pairs = work.save(first.select(F.monotonically_increasing_id().alias("window"), F.col("window").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def tenths(n: int, up: int) -> str:
        return f"{n} * (positive_score DIV 10) + ({n} * (positive_score % 10) + {up}) DIV 10"

    windows = pairs.where("positive_score >= 0").select("window", "anchor_id", F.expr(tenths(high, 0)).alias("high"), F.expr(tenths(low, 9)).alias("low"))
    then = found.first_rows(windows.where("low <= high"), negatives, False)
    return pairs.join(then, "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
