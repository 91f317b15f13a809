"""The Jaccard join against brute force."""

import random
import re

from pacelake.llm import jaccard
from pacelake.llm.jaccard import jaccard_links


def brute(rows, n, percent):
    sets = {}
    for doc, text in rows:
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        sets[doc] = grams or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(sets[d]), find(d)) for d in docs)


def made(seed):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [dice.choice(vocabulary) for _ in range(60)]
    rows, bases = [], []
    for _ in range(12):
        bases.append([dice.choice(vocabulary) for _ in range(dice.choice([3, 12, 25, 60, 150, 700]))] + passage * dice.choice([0, 0, 1]))
    for i in range(300):
        words = list(bases[int(dice.random() ** 2 * 12)])
        for _ in range(dice.choice([0, 0, 1, 1, 2, 3, 8])):
            words[dice.randrange(len(words))] = dice.choice(vocabulary)
        rows.append((i, dice.choice([" ", "\n", "  "]).join(words)))
    return rows + [(900, None), (901, ""), (902, " \t "), (903, "One two"), (904, "one TWO"), (905, "ONE"), (906, "ä Ä"), (907, "Ä Ä")]


def test_against_brute_force(spark):
    for seed, n, percent in ((1, 3, 90), (2, 5, 80)):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, class_id string, n int").repartition(5)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_links(docs, n, percent).collect())
        assert got == brute(rows, n, percent)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_links(docs).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard_links(docs.where("false")).collect() == []


def test_leading_fragment_decides_nothing(spark, monkeypatch):
    """Without a leading fragment, and with all shingles in it, links are the same."""
    rows = made(3)[::3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bound in (0, (1 << 64) - 1):
        monkeypatch.setattr(jaccard, "leading_bound", lambda percent, b=bound: jaccard.np.uint64(b))
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_links(docs, 3, 90).collect()) == brute(rows, 3, 90)


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "x y z"), (6, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_links(docs).collect()) == [(0, 1, 0), (0, 2, 5), (5, 2, 5), (6, 0, 6)]


def test_buckets_filed_anew(spark, monkeypatch):
    """Members of large buckets are filed anew; links are the same, however few make a bucket large."""
    dice = random.Random(5)
    template = [f"t{i}" for i in range(80)]
    rows = made(4)[::2]
    for i in range(1000, 1120):  # most of a template each, with words of their own, and some near copies of these
        words = template + [f"u{i}x{k}" for k in range(14)]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            words[dice.randrange(len(words))] = "other"
            rows.append((i + 500, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 3, 90)
    asked = []
    monkeypatch.setattr(jaccard, "filed_anew", lambda *a, f=jaccard.filed_anew: asked.append(1) or f(*a))
    for rounds, few in ((3, 256), (1, 3), (1, 0)):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "FEW", few)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_links(docs, 3, 90).collect()) == want
    assert len(asked) == 2


def test_pairs_that_share_much_but_too_little_are_not_compared(spark, monkeypatch):
    """Documents put together of the same passages, about 70 % alike: links are the same, and hardly any of their pairs get as far as counts of overlaps."""
    dice = random.Random(6)
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(24)]
    rows = []
    for i in range(90):
        words = [w for k in sorted(dice.sample(range(24), 20)) for w in passages[k]]
        rows.append((i, " ".join(words)))
        if i % 9 == 0:
            words[dice.randrange(len(words))] = "other"
            rows.append((i + 500, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compared = []
    monkeypatch.setattr(jaccard, "overlaps", lambda pairs, segs, f=jaccard.overlaps: compared.append(pairs.count()) or f(pairs, segs))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_links(docs, 5, 80).collect()) == brute(rows, 5, 80)
    assert sum(compared) < 1000
