"""Hard negatives, divergence of sources and packing against plain versions, on rows that are easy to get wrong."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pacelake.llm import divergence, negatives, packing
from pacelake.llm.queries import TOKENIZER

# --- 11 hard negatives -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, is_anchor boolean, score string, window int"


def mined(rows):
    """All scores, sorted; of rows with one id the first counts."""
    clean = {}
    for i, v, label, anchor in sorted((r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        clean.setdefault(i, ([math.floor(256 * x) if abs(x) < 2**50 else int(x) * 256 for x in v], label, bool(anchor)))
    out, most = [], negatives.MOST
    for a, (v, label, anchor) in clean.items():
        if not anchor:
            continue
        scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(v, w)))), i, other) for i, (w, other, _) in clean.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p][:10]
            out += [(a, positive, k, i, -p, -n) for k, (n, i, _) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS).repartition(5)


def test_negatives_with_ties_and_odd_rows(spark):
    dice = np.random.default_rng(3)
    rows = [(i, np.round(dice.normal(0, 0.3, 4), 1).tolist(), int(dice.integers(0, 3)), i % 20 == 0) for i in range(300)]
    # more rows of one score than a pass may leave, in steps of ids that need several digits
    rows += [(1000 + 977 * i, [0.6, 0.6, 0.2, 0.1], 1, False) for i in range(120)] + [(-5 - i, [1.0, 1.0, 0.2, 0.1], 0, i == 3) for i in range(60)]
    odd = [(None, [1.0] * 4, 1, True), (5000000, None, 1, True), (5000001, [1.0, None, 1.0, 1.0], 1, True), (5000002, [1.0, math.nan, 1.0, 1.0], 1, True), (5000003, [1.0, math.inf, 0.0, 0.0], 1, False)]
    odd += [(5000004, [1.0] * 4, None, True), (5000005, [], 1, True), (5000006, [], 1, False), (5000007, [2.0, 1.0], 2, True), (5000008, [1.0, 1.0], 2, False), (5000009, [1.0, 0.2], 1, False), (5000010, [1.0] * 4, 1, None)]
    rows += [*odd, rows[0], rows[0], rows[40], (rows[60][0], [9.0, 0.0, 0.0, 0.0], 2, True)]
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect()))
    assert got == mined(rows) and len(got) > 500


def test_negatives_of_large_numbers_and_far_ids(spark):
    dice = np.random.default_rng(4)
    rows = [(int(i) * (1 << 56) + 3, (dice.normal(0, 1, 3) * s).tolist(), int(dice.integers(0, 2)), bool(i % 9 == 0)) for i, s in zip(range(-60, 60), itertools.cycle([1.0, 1e4, 1e9, 1e13, 1e300]))]
    assert sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect())) == mined(rows)


def test_negatives_without_rows(spark):
    for rows in ([], [(1, [1.0], 1, True)], [(1, [1.0], 1, False), (2, [1.0], 2, False)]):
        assert negatives.hard_negatives(vectors(spark, rows)).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_negatives_by_either_route(spark, few, monkeypatch):
    """Anchors sent to all tasks, or joined by group."""
    monkeypatch.setattr(negatives, "BROADCAST", 1 << 20 if few else 0)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    dice = np.random.default_rng(5)
    rows = [(i, np.round(dice.normal(0, 0.5, 6), 2).tolist(), int(dice.integers(0, 4)), i % 9 == 0) for i in range(400)]
    assert sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect())) == mined(rows)


# --- 12 divergence of sources ----------------------------------------------------------

TEXTS = "doc_id long, text string, lang string, source string, n long, term string, value int"


def diverged(rows):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        sources = [s for g, s in groups if g == lang]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def ranked(part, items, most=None):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            return [(lang, source, part, t, v, k) for k, (t, v) in enumerate(items, 1)]

        p, q = shares(counts[lang, source]), shares(whole)
        out += ranked("term", [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]], 10)
        others = {s: shares(counts[lang, s]) for s in sources if s != source}
        out += ranked("pair", [(s, sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept)) for s, o in others.items()])
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x", 2) for i, r in enumerate(rows)], TEXTS).repartition(5)


def test_divergence_with_odd_rows(spark):
    dice = np.random.default_rng(6)
    words = ["Alpha", "beta", "γάμμα", "delta's", "Ärger", "x", "漢字", "e_f", "wide space", "1two3", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for lang, sources in (("en", ["a", "b", "c", None, "é"]), (None, ["a", ""]), ("de", ["only"]), ("few", ["a", "b"])):
        for _ in range(8 if lang == "few" else 90):
            rows.append((" ".join(dice.choice(words, dice.integers(0, 30), p=np.arange(len(words), 0, -1) / (len(words) * (len(words) + 1) / 2))), lang, sources[int(dice.integers(0, len(sources)))]))
    rows += [(None, "en", "silent"), ("", "en", "a"), ("12 34 _", "en", "signs"), ("Beta beta\x00BETA", "en", "a"), *[rows[0]] * 3, ("long " * 40_000, "en", "b"), ("ß" * 70_000, "en", "b"), (None, "empty", "x"), (None, "empty", "y")]
    got = sorted(map(tuple, divergence.divergence(texts(spark, rows)).collect()))
    assert got == diverged(rows) and {g[2] for g in got} == {"pair", "term"}
    assert divergence.divergence(texts(spark, rows).where("false")).collect() == []


def test_divergence_of_blocks_and_chunks(spark, monkeypatch):
    """Counts of small pieces of the same rows add up."""
    counts = np.random.default_rng(7).integers(0, 5, (200, 6))
    whole, parts = Counter(), Counter()
    for target, step in ((whole, 200), (parts, 7)):
        for at in range(0, 200, step):
            for a, b, left, right, n in divergence._tally(counts[at : at + step]):
                target.update({(a, b, int(x), int(y)): int(k) for x, y, k in zip(left, right, n)})
    assert whole == parts == Counter((a, b, int(r[a]), int(r[b])) for r in counts for b in range(6) for a in range(b))


def test_shares_of_large_counts(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p"), divergence.distance("c", "n").alias("d"))
    assert row.select("p").first()[0] == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 2 * 10**6)


# --- 13 packing -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def check_packed(rows, packed, tokenizer, capacity):
    """Pieces of each text are its ids, and sequences have neither gaps nor too many tokens."""
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            some = ids[at : at + capacity]
            want[doc, k, at, len(some), zlib.crc32(some.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    return len(by), -(-sum(r["length"] for r in packed) // capacity)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Don't STOP 123 it's"), (5, "ünïcødé — 漢字 🙂 é ́x y <|endoftext|>" * 40), (6, "word " * 9000), (None, "no id"), (7, "x" * 3000), (8, "a b c\x85d\x1ce"), (8, "a b c\x85d\x1ce")]


def test_packing_of_odd_rows(spark, tokenizer):
    rows = [*ODD, *((100 + i, "some words of text " * (i % 60)) for i in range(400))]
    docs = spark.createDataFrame([(*r, "x", 3, True) for r in rows], "doc_id long, text string, `offset` string, piece int, open boolean").repartition(6)
    used, least = check_packed(rows, packing.pack(docs, TOKENIZER, capacity=256).collect(), tokenizer, 256)
    assert used <= 1.02 * least + 1
    assert packing.pack(docs.where("false"), TOKENIZER).collect() == []


def test_packing_of_texts_longer_than_a_chunk(spark, tokenizer, monkeypatch):
    words = packing.Words(TOKENIZER)
    monkeypatch.setattr(packing, "CHUNK", 1000)
    monkeypatch.setattr(packing, "WORDS", 50)
    text = "Übung macht den Meister 2024 " * 300 + "y" * 2500 + " end of it"
    import pyarrow as pa

    parts = list(packing._cut(words, pa.array(["short one", text, None, text]), 100))
    for row, t in ((1, text), (3, text)):
        ids = np.concatenate([p[3][p[4][k] : p[4][k + 1]] for p in parts for k in range(len(p[0])) if p[0][k] == row])
        assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert [int(s) for p in parts for r, s in zip(p[0], p[2]) if r == row] == list(range(0, len(ids), 100))


def test_packing_rounds_with_few_open_bins(spark):
    """Many tasks with few open bins: leftovers go through several rounds, and little space is lost."""
    dice = np.random.default_rng(8)
    sizes = np.minimum(1 + dice.gamma(0.9, 180, 6000).astype(int), 512).tolist()
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long").repartition(24)
    packed = packing.pack_pieces(pieces, capacity=512, open_bins=16, fan=4).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(6000))
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert [at for at, _ in sorted(parts)] == list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))[:-1] and sum(n for _, n in parts) <= 512
    assert len(by) <= 1.02 * -(-sum(sizes) // 512)


def test_fullest_bin_closes_first():
    bins, closed = packing.Bins(10, 2), []
    for name, size in (("a", 6), ("b", 7), ("c", 3), ("d", 9), ("e", 8), ("f", 4)):
        bins.put((name,), size, closed)
    # c fills b; e is one bin too many, so d, which has 1 left, closes; f goes to a, where it fits exactly
    assert [r[0] for r in closed] == ["b", "c", "d", "a", "f"] and [r[0] for r in bins.rest(True)] == ["e"]


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"number {i} of some texts " * (i % 9)) for i in range(60)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, TOKENIZER, capacity=128, keep_ids=True)).collect()
    texts_ = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert sum(r["n_tokens"] for r in rows) == sum(map(len, texts_.values()))
    for r in rows:
        assert len(r["ids"]) == r["n_tokens"] <= 128
    ended = sorted(tuple(r["ids"]) for r in rows if len(r["doc_ids"]) == 1)
    assert all(any(tuple(ids[at : at + 128]) == e for ids in texts_.values() for at in range(0, len(ids), 128)) for e in ended)


def test_columns_of_the_queries(spark):
    from pacelake.llm.queries import op13_packing

    packed = op13_packing(spark, "/root/testdata/sf0.001")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.agg(F.countDistinct("doc_id")).first()[0] == 200


def test_parts_of_words_are_tokenized_as_in_whole_texts(tokenizer):
    """Texts of signs that may belong with their neighbours: contractions, digits, special tokens, combining and unusual spaces."""
    import random

    import pyarrow as pa

    dice = random.Random(9)
    signs = [*"abzAZ019.,;:!?'\"<>|-_/\\()[]{}#*&%$@~^`=+ \n\t\x00\x7f", "é", "é", "́", "̸", "漢", " ", "​", "　", "İ", "K", "ß", "'s", "'ll", "'RE", "<|endoftext|>", "½", "٣", "ﬁ", "Σ", "🙂", "\x85", "\x1c"]
    rows = ["".join(dice.choice(signs) for _ in range(dice.choice([0, 1, 3, 10, 60]))) for _ in range(4000)]
    words = packing.Words(TOKENIZER)
    for row, _, _, ids, cuts in packing._cut(words, pa.array(rows), 1 << 30):
        for k, i in enumerate(row):
            assert ids[cuts[k] : cuts[k + 1]].tolist() == [*tokenizer.encode(rows[i], add_special_tokens=False).ids, 0], rows[i]
