"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Every vector is in the graph of one shard, and every shard is queried with the vectors of
all others (each pair of shards once, as cosine is symmetric).  Searches run
for many queries in step: each round expands the best open entries of every beam.

In each shard a search is audited: for some queries all vectors that are linked, or nearly so, are computed exactly, and
the beam is doubled until the search finds enough of them.  A query whose links fill
half of its beam lies in a dense group; such queries are multiplied with the whole shard instead, a block at a time, so dense
groups are found whole.  Links are verified by cosine in double precision.

Equal vectors are one class, and a task passes on only counts and a spanning forest of the
links that it has found, so groups of copies are never expanded into pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work
from pacelake.llm.components import components, forest

#: Vectors in a shard, at most, and shards at least.
SHARD = 65_536
SHARDS = 6
#: Neighbours of a node, on the lowest layer twice as many.
DEGREE = 12
#: Width of beams while a graph is built, and of those that searches begin with.
BEAM, FIRST = 48, 32
#: Queries that are searched in step, and audited in each shard.
STEP = 256
AUDIT = 256
#: The share of pairs that an audit must find; so far below the limit pairs count in it.
RECALL, MARGIN = 0.99, 0.1
#: Similarities in a block of a product.
BLOCK = 1 << 22
#: Tasks that pairs of shards are dealt to, at most.
TASKS = 20_000


class Graph:
    """Layers of neighbours over vectors of length one; ``links[l][v]`` lists up to so many nodes, -1 for none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], top: int):
        self.x, self.links, self.top = x, links, top

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of the beam of each query, best first; -1 and -inf where it isn't full."""
        at = np.full((len(q), 1), self.top, dtype=np.int64)
        for links in self.links[:0:-1]:
            at = self._layer(q, links, at, 1)[0]
        return self._layer(q, self.links[0], at, beam)

    def _layer(self, q: np.ndarray, links: np.ndarray, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x) + 1), dtype=bool)  # one more column, for -1
        seen[:, -1] = True
        seen[rows, at] = True
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -np.inf, dtype=np.float32)
        k = min(beam, at.shape[1])
        ids[:, :k], sims[:, :k] = at[:, :k], np.einsum("qkd,qd->qk", self.x[at[:, :k]], q)
        open_ = ids >= 0
        wide = 1 if beam == 1 else 4
        live = np.arange(len(q))
        while len(live):
            score = np.where(open_[live], sims[live], -np.inf)
            take = np.argpartition(-score, wide - 1, axis=1)[:, :wide] if beam > wide else np.arange(beam)[None, :].repeat(len(live), axis=0)
            good = np.take_along_axis(score, take, axis=1) > -np.inf
            some = good.any(axis=1)
            live, take, good = live[some], take[some], good[some]
            if not len(live):
                break
            open_[live[:, None], take] &= ~good
            new = np.where(good[:, :, None], links[ids[live[:, None], take]], -1).reshape(len(live), -1)
            new[seen[live[:, None], new]] = -1
            seen[live[:, None], new] = True
            # of two entries for one node the second is dropped
            order = np.argsort(new, axis=1)
            ranked = np.take_along_axis(new, order, axis=1)
            ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
            new = ranked
            sim = np.einsum("qkd,qd->qk", self.x[new], q[live]).astype(np.float32)
            sim[new < 0] = -np.inf
            all_ids = np.concatenate((ids[live], new), axis=1)
            all_sims = np.concatenate((sims[live], sim), axis=1)
            all_open = np.concatenate((open_[live], new >= 0), axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row of candidates, best first, those that are nearer to the query than to any chosen before; then the best of the rest."""
    n, k = ids.shape
    v = x[ids]
    cross = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, k), dtype=bool)
    for j in range(k):
        near = np.where(chosen, cross[:, j, :], -np.inf).max(axis=1)
        chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > near) & (chosen.sum(axis=1) < degree)
    spare = degree // 3  # some of the nearest are kept in any case, so that close groups hang together
    chosen[:, :spare] |= ids[:, :spare] >= 0
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :degree]
    return np.where(np.take_along_axis(chosen, order, axis=1), np.take_along_axis(ids, order, axis=1), -1)


def build(x: np.ndarray, keys: np.ndarray, beam: int = BEAM) -> Graph:
    """The graph of the rows of ``x``; a row's layer comes from its key."""
    n = len(x)
    x = np.ascontiguousarray(x, dtype=np.float32)
    u = (tb.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.floor(-np.log(u + 1e-18) / np.log(DEGREE)).astype(np.int64)
    order = np.argsort(-level, kind="stable")  # upper layers first, so that the entry point never moves
    height = int(level.max()) + 1
    links = [np.full((n, DEGREE * (1 if k else 2)), -1, dtype=np.int64) for k in range(height)]
    graph = Graph(x, links, int(order[0]))
    done = 0
    while done < n:
        new = order[done : done + max(1, min(STEP, done))]
        q = x[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        at = np.full((len(new), 1), graph.top, dtype=np.int64)
        for k in range(height - 1, -1, -1):
            here = level[new] >= k
            if done:
                ids, sims = graph._layer(q, links[k], at, beam if here.any() else 1)
            else:
                ids, sims = np.full((len(new), 1), -1, dtype=np.int64), np.full((len(new), 1), -np.inf, dtype=np.float32)
            at = np.where(ids[:, :1] >= 0, ids[:, :1], graph.top)
            if not here.any():
                continue
            mine = min(len(new), beam)
            near = np.argsort(-np.where(here[None, :], own, -np.inf), axis=1)[:, :mine]
            both_ids = np.concatenate((ids, new[near]), axis=1)
            both_sims = np.concatenate((sims, np.take_along_axis(np.where(here[None, :], own, -np.inf), near, axis=1)), axis=1)
            both_ids[both_sims == -np.inf] = -1
            best = np.argsort(-both_sims, axis=1, kind="stable")[:, :beam]
            ids, sims = np.take_along_axis(both_ids, best, axis=1)[here], np.take_along_axis(both_sims, best, axis=1)[here]
            rows = new[here]
            degree = links[k].shape[1]
            picked = _diverse(x, ids, sims, degree // 2 if not k else degree)
            links[k][rows, : picked.shape[1]] = picked
            _link_back(x, links[k], rows, picked)
        done += len(new)
    return graph


def _link_back(x: np.ndarray, links: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> None:
    """Add the new nodes to the lists of their neighbours; lists that overflow are chosen anew."""
    to, who = picked.ravel(), np.repeat(rows, picked.shape[1])
    who, to = who[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, who = to[order], who[order]
    nodes, first, size = np.unique(to, return_index=True, return_counts=True)
    degree = links.shape[1]
    width = degree + int(size.max(initial=0))
    lists = np.full((len(nodes), width), -1, dtype=np.int64)
    lists[:, :degree] = links[nodes]
    lists[np.repeat(np.arange(len(nodes)), size), degree + np.arange(len(to)) - np.repeat(first, size)] = who
    lists.sort(axis=1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
    count = (lists >= 0).sum(axis=1)
    few = count <= degree
    part = -np.sort(-lists[few], axis=1)[:, :degree]
    links[nodes[few]] = part
    for some in np.array_split(np.flatnonzero(~few), max(1, (~few).sum() // 512)):
        if len(some):
            ids = lists[some]
            sims = np.einsum("qkd,qd->qk", x[ids], x[nodes[some]])
            sims[ids < 0] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")[:, : min(width, 3 * degree)]
            links[nodes[some]] = _diverse(x, np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1), degree)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _index(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids, v = table.column("id").to_numpy(), _matrix(table.column("v"))
    graph = build(_units(v), ids)
    out = io.BytesIO()
    np.savez(out, ids=ids, m=table.column("m").to_numpy(), v=v, top=np.array(graph.top), **{f"l{k}": a.astype(np.int32) for k, a in enumerate(graph.links)})
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["dim", "shard", "graph"])


def audited_beam(graph: Graph, q: np.ndarray, cosine: float, keys: np.ndarray) -> tuple[int, int, int]:
    """The width of beam with which audits pass, the pairs that it finds of those audited, and how many there are."""
    n = len(graph.x)
    some = np.argsort(tb.mix(keys.astype(np.int64).view(np.uint64)), kind="stable")[:AUDIT]
    near = q[some] @ graph.x.T >= cosine - MARGIN
    many = near.sum(axis=1)
    beam = min(FIRST, n)
    while True:
        few = np.flatnonzero((many > 0) & (many * 2 <= beam))  # the others are found by products
        ids, _ = graph.search(q[some[few]], beam)
        found = int((np.take_along_axis(near[few], np.maximum(ids, 0), axis=1) & (ids >= 0)).sum())
        if beam == n or found >= RECALL * many[few].sum():
            return beam, found, int(many[few].sum())
        beam = min(2 * beam, n)


def link_search(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(queries, nodes, whether all links of these queries) of the pairs with at least this cosine, for some queries at a time; ``x`` and ``q`` are unit vectors in double precision."""
    q32, dense = q.astype(np.float32), []
    for first in range(0, len(q), STEP):
        part = np.arange(first, min(first + STEP, len(q)))
        ids, sims = graph.search(q32[part], beam)
        close = (sims >= cosine - 1e-4) & (ids >= 0)
        full = close.sum(axis=1) * 2 > beam
        dense.append(part[full])
        a, k = np.nonzero(close & ~full[:, None])
        a, b = part[a], ids[a, k]
        good = np.einsum("kd,kd->k", q[a], x[b]) >= cosine
        yield a[good], b[good], False
    rest = np.concatenate(dense) if dense else np.zeros(0, dtype=np.int64)
    step = max(1, BLOCK // len(x))
    for first in range(0, len(rest), step):
        part = rest[first : first + step]
        a, b = np.nonzero(q[part] @ x.T >= cosine)
        yield part[a], b, True


def _links_within(graph: Graph, x: np.ndarray, ids: np.ndarray, m: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many vectors each one of a shard is linked with, and a spanning forest of the links."""
    n = len(x)
    counts, whole = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    pairs, ea, eb = [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for a, b, all_ in link_search(graph, x, x, cosine, beam):
        a, b = a[a != b], b[a != b]
        if all_:
            whole[a] = True
            counts += np.bincount(a, m[b], n).astype(np.int64)
            pairs.append(b * n + a)
        else:
            pairs += [a * n + b, b * n + a]
        if len(pairs) > 64:
            pairs = [_unless(pairs, whole, n)]
        ea, eb = forest(np.concatenate((ea, np.maximum(ids[a], ids[b]))), np.concatenate((eb, np.minimum(ids[a], ids[b]))))
    left = _unless(pairs, whole, n)  # both ends may have found a pair
    return counts + np.bincount(left // n, m[left % n], n).astype(np.int64), ea, eb


def _unless(pairs: list[np.ndarray], whole: np.ndarray, n: int) -> np.ndarray:
    codes = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return codes[~whole[codes // n]]


def embedding_links(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audit_recall`` of every row of ``vectors``.

    ``vectors`` needs ``vec_id`` (unique) and ``embedding``; other columns are ignored. Two vectors of one
    dimension are linked if their cosine in double precision is at least ``cosine``. A vector that is null,
    empty or zero or holds nulls or non-finite components is linked with nothing. ``n_links`` counts
    the other vectors linked directly, ``component_id`` is the smallest vec_id that links lead to. ``audit_recall`` is the share of the
    audited pairs, of all shards together, that searches found; it is the same in all rows. Repeated rows
    count as vectors of their own; a row without vec_id is linked with nothing.
    """
    v = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = work.save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("usable", usable))
    good = rows.where("usable and vec_id is not null")
    classes = work.save(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    shards = max(SHARDS, -(-n // SHARD))
    placed = classes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = work.save(placed.repartition(shards, "shard").groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, graph binary"))

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "n", "root", "audited"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        with np.load(io.BytesIO(right.column("graph")[0].as_py())) as z:
            ids, m, x, top = z["ids"], z["m"], z["v"], int(z["top"])
            links = [z[f"l{k}"].astype(np.int64) for k in range(len(z.files) - 4)]
        left = left.sort_by("id")
        mine, weight, q = left.column("id").to_numpy(), left.column("m").to_numpy(), _units(_matrix(left.column("v")))
        x = _units(x)
        graph = Graph(x.astype(np.float32), links, top)
        beam, hits, audited = audited_beam(graph, q.astype(np.float32), cosine, mine)
        if key[1].as_py() == key[2].as_py():
            n_x, ea, eb = _links_within(graph, x, ids, m, cosine, beam)
            n_q = np.zeros(len(q), dtype=np.int64)
        else:
            ea, eb = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            n_q, n_x = np.zeros(len(q), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            for a, b, _ in link_search(graph, x, q, cosine, beam):
                n_q += np.bincount(a, m[b], len(q)).astype(np.int64)
                n_x += np.bincount(b, weight[a], len(x)).astype(np.int64)
                ea, eb = forest(np.concatenate((ea, np.maximum(mine[a], ids[b]))), np.concatenate((eb, np.minimum(mine[a], ids[b]))))
        out_id = np.concatenate((mine[n_q > 0], ids[n_x > 0], ea))
        out_n = np.concatenate((n_q[n_q > 0], n_x[n_x > 0], np.zeros(len(ea), dtype=np.int64)))
        out_root = np.concatenate((mine[n_q > 0], ids[n_x > 0], eb))
        # the last row is the audit: pairs found, and pairs there are
        cols = [np.append(out_id, 0), np.append(out_n, hits), np.append(out_root, 0), np.append(np.full(len(out_id), -1), audited)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)

    to = F.explode(F.sequence(F.col("shard"), F.lit(shards - 1))).alias("j")
    of = F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("i")
    tasks = min(2 * shards * (shards + 1), TASKS)
    queries = placed.select("dim", F.col("shard").alias("i"), to, "id", "m", "v").repartition(tasks, "dim", "i", "j")
    indexes = graphs.select("dim", of, F.col("shard").alias("j"), "graph").repartition(tasks, "dim", "i", "j")
    found = work.save(queries.groupBy("dim", "i", "j").cogroup(indexes.groupBy("dim", "i", "j")).applyInArrow(find, "id long, n long, root long, audited long"))
    work.drop(graphs)
    audit = found.where("audited >= 0").agg(F.sum("n"), F.sum("audited")).first()
    recall = audit[0] / audit[1] if audit[1] else 1.0
    found = found.where("audited < 0")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("id <> root"), "id", "root")
    each = classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select("v", "m", "id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root"))
    known = good.select("vec_id", "v").join(each, "v").select("vec_id", (F.col("m") - 1 + F.col("n")).cast("long").alias("n_links"), F.col("root").alias("component_id"))
    rest = rows.where("not usable or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(recall))
