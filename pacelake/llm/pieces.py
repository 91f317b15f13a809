"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces of a vocabulary that occur in a text span a lattice.  Going forward, each
node gets the summed weight of all paths that lead to it (filtering); going backward
from the end, pieces are drawn by their share of that weight (sampling), so every
segmentation comes up with its own probability.  The random numbers are a hash of the row
key, the word's place and the step, so a row's segmentation is the same in every run and partition.

No piece of the vocabularies in question goes on after a space that follows something else, so
a lattice falls into words.  The lattices of the distinct words of a few megabytes are built and filtered
together, node by node over all words at once; then all words are sampled together, one piece of each
at a time.  Characters that are no piece themselves are written as byte pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb

#: Bytes of text that are encoded together; longer texts are encoded in parts of whole words.
CHUNK = 1 << 20
#: The mark that stands for a space within pieces.
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes, a space for the mark; for each length the hashes of what pieces start with."""

    starts: list[tuple[np.ndarray, np.ndarray]]  # by length - 1: sorted hashes, id of the piece or -1
    bytes_: np.ndarray  # ids of the 256 byte pieces
    log_weight: np.ndarray  # by id
    text: np.ndarray  # bytes of all pieces
    ends: np.ndarray  # where each piece ends in them, after a 0


def load(path: str, smoothing: float = 1.0) -> Vocabulary:
    """Read a SentencePiece model. The weight of a piece is 1 / rank ** smoothing, by the order of scores in the model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw: list[bytes] = []
    bytes_ = np.full(256, -1, dtype=np.int64)
    real = []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            raw.append(b"")
        else:
            raw.append(piece.encode().replace(SPACE_MARK.encode(), b" "))
            if b" " in raw[-1].lstrip(b" "):
                raise ValueError(f"piece {i} of {path} goes on after a space, so texts don't fall into words")
            real.append(i)
    if (bytes_ < 0).any():
        raise ValueError(f"{path} has no byte pieces, so not every text can be encoded")
    score = np.array([model.get_score(i) for i in range(n)])
    rank = np.empty(n)
    rank[np.argsort(-score, kind="stable")] = np.arange(1, n + 1)
    rank[bytes_] = n
    found: list[dict[bytes, int]] = []
    for i in real:
        for size in range(1, len(raw[i]) + 1):
            while len(found) < size:
                found.append({})
            found[size - 1].setdefault(raw[i][:size], -1)
        found[len(raw[i]) - 1][raw[i]] = i
    starts = []
    for size, table in enumerate(found, 1):
        flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        at = np.arange(len(table)) * size
        h = tb.span_hashes(tb.prefix_sums(flat), at, at + size)
        order = np.argsort(h)
        starts.append((h[order], np.array(list(table.values()), dtype=np.int64)[order]))
    return Vocabulary(starts, bytes_, -smoothing * np.log(rank), np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))


def lattice(buf: np.ndarray, first: np.ndarray, last: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of all edges over the bytes of words, each [first, last) of ``buf``."""
    sums = tb.prefix_sums(buf)
    stop = np.repeat(last, last - first)
    at = np.arange(len(buf))
    width = np.ones(len(buf), dtype=np.int64)  # of the character that starts here
    width[buf >= 0xC0], width[buf >= 0xE0], width[buf >= 0xF0] = 2, 3, 4
    lead = (buf & 0xC0) != 0x80
    own = np.zeros(len(buf), dtype=bool)
    edges = []
    live = at[lead]
    for size, (hashes, ids) in enumerate(v.starts, 1):
        live = live[live + size <= stop[live]]
        if not len(live):
            break
        h = tb.span_hashes(sums, live, live + size)
        maybe = np.zeros(1 << 18, dtype=bool)
        maybe[hashes & np.uint64(0x3FFFF)] = True
        hit = maybe[h & np.uint64(0x3FFFF)]
        live, h = live[hit], h[hit]
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[k] == h
        live, k = live[hit], ids[k[hit]]
        whole = k >= 0
        edges.append(tuple(x.astype(np.int32) for x in (live[whole], live[whole] + size, k[whole])))
        own[live[whole][width[live[whole]] == size]] = True
    head = np.maximum.accumulate(np.where(lead, at, 0))  # the character of each byte
    loose = np.flatnonzero(~own[head])
    edges.append(tuple(x.astype(np.int32) for x in (loose, loose + 1, v.bytes_[buf[loose]])))
    return tuple(np.concatenate(x) for x in zip(*edges, strict=True))  # type: ignore[return-value]


def filtered(buf: np.ndarray, first: np.ndarray, last: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges in order of their end nodes, longest first: start node, id and cumulated probability; and where each node's begin.

    The node before byte i of word w is i + w, so that words share none.
    """
    start, end, piece = lattice(buf, first, last, v)
    word = np.repeat(np.arange(len(first), dtype=np.int32), last - first)
    source, node = start + word[start], end + word[start]
    depth, size = end - first[word[start]], end - start
    # two keys, as depth and node of long words don't fit into one of 64 bits; no two edges are equal
    step = np.lexsort((node * np.int64(len(v.starts) + 1) - size, depth))
    depth, node, source, piece = depth[step], node[step], source[step], piece[step]
    del start, end, word, size, step
    weight = v.log_weight[piece]
    alpha = np.zeros(len(buf) + len(first))
    value = np.empty(len(node))
    cut = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2)) if len(depth) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            continue
        x = alpha[source[a:b]] + weight[a:b]
        group = np.flatnonzero(np.concatenate(([True], node[a + 1 : b] != node[a : b - 1])))
        many = np.diff(np.concatenate((group, [b - a])))
        top = np.maximum.reduceat(x, group)
        share = np.exp(x - np.repeat(top, many))
        whole = np.add.reduceat(share, group)
        alpha[node[a:b][group]] = top + np.log(whole)
        # probabilities cumulated within each node
        sums = np.cumsum(share)
        value[a:b] = (sums - np.repeat(sums[group] - share[group], many)) / np.repeat(whole, many)
    at = np.zeros(len(alpha) + 1, dtype=np.int64)
    at[1:] = np.cumsum(np.bincount(node, minlength=len(alpha)))
    # edges of a node lie together at each depth already, so they only move as blocks
    group = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.concatenate((group, [len(node)]))) if len(node) else group
    to = np.repeat(at[node[group]] - group, many) + np.arange(len(node))
    out_source, out_piece, out_value = np.empty_like(source), np.empty(len(piece), dtype=np.int32), np.empty_like(value)
    out_source[to], out_piece[to], out_value[to] = source, piece, value
    out_value[at[1:][np.diff(at) > 0] - 1] = 1.0
    return out_source, out_piece, out_value, at


def encode(buf: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, v: Vocabulary, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of texts, given as bytes and offsets, and where each text's ids end, after a 0."""
    if len(seeds) == 1 and len(buf) > limit:
        space = buf == 0x20
        opens = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # where words begin, but for the first
        cuts = [0]
        while cuts[-1] + limit < len(buf):
            k = int(np.searchsorted(opens, cuts[-1] + limit, side="right"))
            if k and opens[k - 1] > cuts[-1]:
                k -= 1
            cuts.append(int(opens[k]) if k < len(opens) else len(buf))
        cuts = cuts if cuts[-1] == len(buf) else [*cuts, len(buf)]
        parts = [_encode(buf[a:b], np.array([0, b - a]), seeds, v, not a, int(np.searchsorted(opens, a)) + (a > 0))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])
    return _encode(buf, offsets, seeds, v, True, 0)


def _encode(buf: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, v: Vocabulary, whole: bool, before: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``; a text that isn't whole goes on after ``before`` words."""
    n = np.diff(offsets)
    # a space before every text that isn't empty
    led = (n > 0) & whole
    moved = np.concatenate(([0], np.cumsum(n + led)))
    padded = np.full(moved[-1], 0x20, dtype=np.uint8)
    inside = np.ones(moved[-1], dtype=bool)
    inside[moved[:-1][led]] = False
    padded[inside] = buf[offsets[0] : offsets[-1]]
    # words start at each space that follows something else, and at texts
    space = padded == 0x20
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[moved[:-1][n > 0]] = True
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [len(padded)])) if len(first) else first
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(len(n) + 1, dtype=np.int64)
    h = tb.span_hashes(tb.prefix_sums(padded), first, last)
    _, example, kind = np.unique(h, return_index=True, return_inverse=True)
    size = (last - first)[example]
    w_last = np.cumsum(size)
    w_first = w_last - size
    flat = padded[np.repeat(first[example] - w_first, size) + np.arange(w_last[-1])]
    source, piece, cumulated, begins = filtered(flat, w_first, w_last, v)
    # sample backwards, all words at once
    doc = np.searchsorted(moved, first, side="right") - 1
    place = np.arange(len(first)) - np.searchsorted(first, moved[:-1])[doc] + before
    state = tb.mix(seeds[doc] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    origin = w_first[kind] + kind
    node = w_last[kind] + kind
    live = np.arange(len(first))
    count = np.zeros(len(first), dtype=np.int64)
    steps = []
    while len(live):
        state = tb.mix(state)
        u = (state >> np.uint64(11)).astype(np.float64) / (1 << 53)
        e = begins[node]
        later = np.flatnonzero(u >= cumulated[e])
        while len(later):
            e[later] += 1
            later = later[u[later] >= cumulated[e[later]]]
        steps.append((live, piece[e]))
        count[live] += 1
        node = source[e]
        go = node > origin
        live, node, origin, state = live[go], node[go], origin[go], state[go]
    ends = np.cumsum(count)
    out = np.empty(ends[-1], dtype=np.int64)
    for k, (who, p) in enumerate(steps):
        out[ends[who] - 1 - k] = p
    by_doc = np.concatenate(([0], ends))[np.searchsorted(first, moved)]
    return out, by_doc


def decode(ids: np.ndarray, by_doc: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and their offsets: the pieces joined, without the space in front."""
    size = v.ends[ids + 1] - v.ends[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    joined = v.text[np.repeat(v.ends[ids] - (ends - size), size) + np.arange(total)]
    at = np.concatenate(([0], ends))[by_doc]
    full = np.diff(at) > 0
    keep = np.ones(total, dtype=bool)
    keep[at[:-1][full]] = False
    return joined[keep], np.concatenate(([0], np.cumsum(np.diff(at) - full)))


def _seeds(keys: pa.Array, seed: int) -> np.ndarray:
    return tb.mix(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + tb.mix(np.array([seed], dtype=np.uint64)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, seed: int = 0, smoothing: float = 1.0) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``: a sampled segmentation of the whole text; an empty one for null and empty texts.

    ``path`` is a SentencePiece model with byte pieces. Equal texts with one doc_id get equal ids. Columns other than doc_id
    and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path, smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = _seeds(batch.column(0), seed)
            for first, end, buf, offsets in tb.chunks(batch.column(1), CHUNK):
                ids, by_doc = encode(buf, offsets, seeds[first:end], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _keyed(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of every row of ``encoded`` (``doc_id, ids``)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            by_doc = lists.offsets.to_numpy().astype(np.int64)
            data, offsets = decode(ids, by_doc - by_doc[0], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, seed: int = 0, smoothing: float = 1.0, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_sha256, lossless``, and ``ids`` if asked for, of every row: texts are encoded, decoded and compared in one pass.

    The digest is that of the ids as little-endian 32-bit integers. A null text counts as empty, which has no piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path, smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = _seeds(batch.column(0), seed)
            for first, end, buf, offsets in tb.chunks(batch.column(1), CHUNK):
                ids, by_doc = encode(buf, offsets, seeds[first:end], shared.value)
                data, back = decode(ids, by_doc, shared.value)
                raw, n = ids.astype("<i4").tobytes(), end - first
                same = [bool(np.array_equal(data[back[i] : back[i + 1]], buf[offsets[i] : offsets[i + 1]])) for i in range(n)]
                sha = [hashlib.sha256(raw[4 * by_doc[i] : 4 * by_doc[i + 1]]).hexdigest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(offsets)), pa.array(np.diff(by_doc)), pa.array(sha, pa.string()), pa.array(same, pa.bool_()), *([pa.ListArray.from_arrays(pa.array(by_doc.astype(np.int32)), pa.array(ids.astype(np.int32)))] if keep_ids else [])], ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "lossless", *["ids"] * keep_ids])

    return _keyed(docs).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids)
