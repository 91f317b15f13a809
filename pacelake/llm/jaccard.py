"""Exact Jaccard join of word-shingle sets, by vertical partitioning.

The global order of shingles is cut into fragments by their 64-bit hashes.  Within the leading
fragment, rarer shingles come first; the others follow by hash.

*Candidates.*  Two sets of which one has n shingles are linked only if they share one of its first
``n - ceil(t * n) + 1`` shingles in the global order.  The leading fragment is made twice as large as
that share, so hardly any set needs more than it: only its shingles are counted over all documents, those that stand in one
document only are dropped there, and sets without any other among their first ones take no further part.
Sets that need more than the leading fragment are filed under their first shingles of the next ones as well.

*Sketches.*  A sketch holds, for each of 256 slots, whether it got an odd number of shingles.  Two sets
differ in at least as many shingles as their sketches in bits, so pairs that differ in too many bits are left out where buckets are joined.
Of those that remain, a sketch of 1,024 slots, of which there is one a document, leaves out most that share much but too little; what is left is about as similar as a link.

*Overlaps.*  For each candidate pair the overlaps are counted fragment by
fragment and summed per pair; a link needs ``100 * overlap >= percent * union``.

*Groups of copies.*  Equal sets are one class.  The documents filed under one shingle are a bucket, and each bucket has a pivot, its most typical document.
Each document is compared with the pivot of its largest bucket, and where the bucket is not connected by that, with
another pivot, which links a group of near copies by about as many pairs as it has members.  In buckets that
still hold several components, all members outside the largest one are compared with all members.  Where more than ``FEW`` are
outside, as in a template that many unlinked documents share, the members are first filed anew, under their first shingles of all fragments, rarest
first among these members: those that differ enough have none in common there.  No link between components is lost, and
no group of copies is expanded into all its pairs.

Counts are combined before the shuffle and joined back by sort-merge joins, which Spark splits where a key is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import textblocks as tb
from pacelake.llm import work
from pacelake.llm.components import components

#: Fragments in which overlaps are counted.
PARTS = 8
#: Turns in which each document is compared with one pivot, at most, and the comparisons a row for which no more such turns are made;
#: buckets with more members outside their largest component are filed anew. Both decide the route, never the result.
ROUNDS, FEW = 3, 256
SKETCH = ["s0", "s1", "s2", "s3"]
#: Slots of the second sketch.
WIDE = 1024


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than n words is one shingle."""
    for first, end, buf, offsets in tb.chunks(column):
        word, before = tb.word_hashes(buf, offsets)
        gram, starts = tb.gram_hashes(word, before, n)
        for i in range(end - first):
            if starts[i + 1] > starts[i]:
                yield np.unique(gram[starts[i] : starts[i + 1]])
            elif before[i + 1] > before[i]:
                k = before[i + 1] - before[i]
                yield tb.gram_hashes(word[before[i] : before[i + 1]], np.array([0, k]), int(k))[0] ^ np.uint64(k)
            else:
                yield np.zeros(0, dtype=np.uint64)


def sketch(h: np.ndarray, slots: int = 256) -> np.ndarray:
    """One bit a slot, 64 in an integer: whether each slot holds an odd number of hashes."""
    odd = np.bincount(((h >> np.uint64(20)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def leading_bound(percent: int) -> np.uint64:
    """The largest hash of the leading fragment, which holds twice the share of shingles that a set may lack in a link."""
    return np.uint64(min((2 * (100 - percent) << 64) // 100, (1 << 64) - 1))


def shingle_digests(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, number of first shingles of which links share one, number of those in the leading fragment, two digests and the sketches of the shingle set, the shingles in the leading fragment, and the first ones of the next if those are too few."""

    bound = leading_bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, leading, d1, d2, odd, wide, lead, rest = [], [], [], [], [], [], [], [], []
            for h in _sets(batch.column(1), n):
                need = len(h) - -(-len(h) * percent // 100) + 1
                cut = int(np.searchsorted(h, bound, side="right"))
                sizes.append(len(h))
                first.append(need)
                leading.append(cut)
                odd.append(sketch(h))
                wide.append(sketch(h, WIDE).view(np.uint64))
                d1.append(int(np.sum(tb.mix(h)).astype(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(tb.mix(h ^ np.uint64(0xA5A5A5A5))).astype(np.int64)) if len(h) else 0)
                lead.append(h[:cut])
                rest.append(h[cut : max(cut, need)] if len(h) else h)
            numbers = [pa.array(x, pa.int64()) for x in (sizes, first, leading, d1, d2, *([x[i] for x in odd] for i in range(4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, _lists(wide), _lists(lead), _lists(rest)], ["doc_id", "n", "first", "leading", "d1", "d2", *SKETCH, "wide", "lead", "rest"])

    return docs.mapInArrow(run, "doc_id long, n long, first long, leading long, d1 long, d2 long, s0 long, s1 long, s2 long, s3 long, wide array<long>, lead array<long>, rest array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def filed_under(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``key, doc, n`` and the sketch, as a table: each document of ``reps`` under those of its first shingles that other documents may have."""
    placed = sets.select(F.col("doc_id").alias("doc"), F.explode("lead").alias("h"))
    # as a table of its own, so that Spark can split the join where one shingle is in many documents
    shared = work.save(placed.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    mine = placed.join(shared, "h").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("items"))
    own = reps.select(F.col("doc_id").alias("doc"), "n", *SKETCH, "first", "leading")
    # those in no other document come first in the order
    many = F.greatest(F.col("first") - F.col("leading") + F.size("items"), F.lit(0)).cast("int")
    lead = own.join(mine, "doc").select(F.explode(F.slice("items", F.lit(1), many)["h"]).alias("key"), "doc", "n", *SKETCH)
    filed = work.save(lead.union(reps.select(F.explode("rest").alias("key"), F.col("doc_id").alias("doc"), "n", *SKETCH)))
    work.drop(shared)
    return filed


def filed_anew(members: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """``key, doc, n, root`` and the sketch, as a table: each of ``members`` under those of its first shingles that other members have.

    The order is that of all fragments, shingles in fewer members first. Two linked members share one of those.
    """
    placed = segs.join(members.select("doc"), "doc", "left_semi").select("doc", F.explode("h").alias("h"))
    # as a table of its own, so that Spark can split the join where one shingle is in many documents
    shared = work.save(placed.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    mine = placed.join(shared, "h").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("items"))
    # of the first n - ceil(n * percent / 100) + 1, those in no other member come first in the order
    many = F.greatest(F.size("items") - F.ceil(F.col("n") * percent / 100) + 1, F.lit(0)).cast("int")
    filed = work.save(members.join(mine, "doc").select(F.explode(F.slice("items", F.lit(1), many)["h"]).alias("key"), "doc", "n", "root", *SKETCH))
    work.drop(shared)
    return filed


def still_open(entries: DataFrame) -> DataFrame:
    """Entries of the buckets that hold several components, with the members of the bucket, the largest component and the members outside it."""
    members = entries.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("main"))
    return entries.join(members.where("roots > 1").select("key", "size", F.col("main.root").alias("main"), (F.col("size") - F.col("main.c")).alias("outside")), "key")


def segments(docs: DataFrame, n: int) -> DataFrame:
    """doc, size, fragment and the hashes that the fragment holds of the document's set, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, part, ends, flat = [], [], [], [0], []
            for doc, h in zip(batch.column(0).to_pylist(), _sets(batch.column(1), n), strict=True):
                cut = np.searchsorted(h >> np.uint64(61), np.arange(PARTS + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(cut)):
                    ids.append(doc)
                    size.append(len(h))
                    part.append(int(k))
                    ends.append(ends[-1] + int(cut[k + 1] - cut[k]))
                flat.append(h)
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))], ["doc", "size", "part", "h"]
            )

    return docs.mapInArrow(run, "doc long, size long, part int, h array<long>")


def near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that differ in few enough bits of the second sketch, once each."""
    one, two = (known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    bits = "aggregate(zip_with(wide_a, wide_b, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x)"
    return pairs.join(one, "a").join(two, "b").where(f"{100 + percent} * {bits} <= {100 - percent} * (na + nb)").select("a", "b").distinct()


def overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """``a, b, na, nb, overlap`` of each pair: partial overlaps per fragment, summed per pair."""
    left = segs.select(F.col("doc").alias("a"), F.col("size").alias("na"), "part", F.col("h").alias("ha"))
    right = segs.select(F.col("doc").alias("b"), F.col("size").alias("nb"), "part", F.col("h").alias("hb"))
    each = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "part", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("k"))
    return each.distinct().groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("k").alias("overlap"))


def jaccard_links(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Classes of documents whose shingle sets are linked.

    ``docs`` needs ``doc_id`` (unique; repeated equal rows give repeated equal
    results) and ``text``; other columns are ignored.  Words are runs of bytes
    other than ASCII white space, A-Z taken as a-z.  Returns ``doc_id,
    n_shingles, class_id, component_id``: the size of the set, the smallest
    doc_id with an equal set and the smallest that links lead to.  A null or
    empty text has no shingle and is linked with nothing.  A row without doc_id links no others; it gets the
    ``component_id`` of documents with its own set, if there are any.  Shingles are compared by 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = work.save(shingle_digests(texts, n, percent))
    known = sets.where("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    reps = known.drop("lead", "wide").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    filed = filed_under(known, reps)
    shared = filed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    entries = work.save(filed.join(shared, "key"))
    work.drop(filed)
    typical = entries.groupBy("doc").agg(F.sum("m").alias("typical"), F.max(F.struct("m", "key")).alias("most"))
    ranked = work.save(entries.join(typical, "doc").select("key", "doc", "n", *SKETCH, "typical", (F.col("most.key") == F.col("key")).alias("largest")))
    work.drop(entries)
    met = work.save(ranked.select(F.col("doc").alias("doc_id")).distinct())
    segs = work.save(segments(texts.join(met, "doc_id", "left_semi"), n))
    work.drop(met)

    columns = ["doc", "n", "root", *SKETCH]
    bits = " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in SKETCH)
    may_link = f"a.root <> b.root and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and {100 + percent} * ({bits}) <= {100 - percent} * (a.n + b.n)"
    linked = f"100 * overlap >= {percent} * (na + nb - overlap)"
    ends = [F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b")]
    tested = roots = None
    tables = []
    entries_of = ranked.columns
    before = ranked  # entries of buckets that aren't connected yet
    for turn in range(ROUNDS + 1):
        here = before.withColumn("root", F.col("doc")) if roots is None else before.select(entries_of).join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        here = work.save(still_open(here))
        work.drop(before)
        before = here
        rows, apart, outside = here.agg(F.count("*"), F.sum(F.when(F.col("root") != F.col("main"), F.col("size"))), F.max("outside")).first()
        if not rows:
            break
        if not turn or (turn < ROUNDS and apart > FEW * rows):
            best = here.groupBy("key").agg(F.max(F.struct("typical", (-F.col("doc")).alias("after"), *columns)).alias("best"))
            best = best.select("key", *[F.col(f"best.{c}").alias(c) for c in columns])
            found = best.alias("a").join((here if turn else here.where("largest")).alias("b"), "key").where(may_link).select(*ends, F.col("b.doc").alias("member"), "size")
            if tested is not None:
                found = found.join(tested, ["a", "b"], "left_anti")
            found = found.groupBy("member").agg(F.max(F.struct("size", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
            last = False
        else:
            few = here.where(F.col("outside") <= FEW)
            found = few.where("root <> main").alias("a").join(few.alias("b"), "key").where(may_link).select(*ends)
            if outside > FEW:
                anew = filed_anew(here.where(F.col("outside") > FEW).select(*columns).distinct(), segs, percent)
                many = still_open(anew)
                tables.append(anew)
                found = found.union(many.where("root <> main").alias("a").join(many.alias("b"), "key").where(may_link).select(*ends))
            found = found.distinct().join(tested, ["a", "b"], "left_anti")
            last = True
        seen = work.save(overlaps(near(found, known, percent), segs))
        tables.append(seen)
        tested = seen.select("a", "b") if tested is None else tested.union(seen.select("a", "b"))
        fresh = seen.where(linked).select("a", "b")
        roots = components(fresh if roots is None else fresh.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if last:
            break
    if roots is None:
        roots = components(sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false"))
    work.drop(before, segs, *tables)

    own = sets.drop("wide", "lead", "rest").join(classes, ["n", "d1", "d2"], "left")
    return own.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("root", "class_id", "doc_id").alias("component_id")
    )
