"""The pipeline as a whole, and its stages one by one, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from pacelake.llm import pieces, quality
from pacelake.llm.queries import PIECES
from test_jaccard import brute
from test_operators import plain_statistics, segmented, tiled

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(rows, model):
    def good(text):
        x = plain_statistics(text)
        return model.bias + sum(r.weight for r in model.rules if all((x[s] > v) == above for s, above, v in r.terms)) >= 0

    return {d: t for d, t in rows.items() if good(t)}


def plain_near_copies(rows):
    return {d: rows[d] for d, _, root in brute(list(rows.items()), 5, 80) if d == root}


def plain_repeats(rows, length=200):
    raw = {d: (t or "").encode() for d, t in rows.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[d] = rows[d] if rows[d] is None or not any(gone) else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def plain_decontamination(rows, items, least=5):
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    items = [w for w in map(split, items) if w]

    def dirty(text):
        doc = split(text)
        for item in items:
            n = min(least, len(item))
            if runs(item, n) & runs(doc, n) and sum(size for _, _, size in tiled(item, doc, n)) >= 0.8 * len(item):
                return True
        return False

    return {d: t for d, t in rows.items() if not dirty(t)}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with planted copies, near copies, repeated passages, benchmark items and odd texts."""
    dice = random.Random(5)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 200 and 700").orderBy("doc_id").limit(60).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    first = sorted(docs)[0]
    words = docs[first].split(" ")
    passage = " ".join("".join(dice.choice("abcdefghilmnoprstuv") for _ in range(6)) for _ in range(40))
    docs |= {100_001: docs[first], 100_002: " ".join(words[:-1] + ["changed"]), 100_003: passage + " " + docs[sorted(docs)[3]], 100_004: docs[sorted(docs)[4]] + " " + passage + " é", 100_005: docs[sorted(docs)[5]] + " " + items[0]}
    half = items[1].split(" ")
    docs |= {100_006: " ".join(half[len(half) // 2 :] + docs[sorted(docs)[6]].split(" ") + half[: len(half) // 2]), 100_007: None, 100_008: "", 100_009: " \n"}
    d = str(tmp_path_factory.mktemp("made"))
    rows = [(k, t, None if k % 2 else "en", "src", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d, docs, items


def test_pipeline_against_plain_python(spark, made):
    d, docs, items = made
    model = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    after = [plain_quality(docs, model)]
    after.append(plain_near_copies(after[-1]))
    after.append(plain_repeats(after[-1]))
    after.append(plain_decontamination(after[-1], items))
    table = spark.read.parquet(f"{d}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], after, strict=True):
        table = corpus_pipeline.work.save(stage(spark, table, d))
        assert {r["doc_id"]: r["text"] for r in table.collect()} == want and table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(after[1]) < len(after[0]) and after[2] != after[1] and len(after[3]) < len(after[2]) and len(after[3]) > 20
    v = pieces.load(PIECES)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {k: segmented(k, t, v) for k, t in after[3].items()}


def test_stages_on_odd_tables(spark, made):
    """Nulls, ties, repeated rows, clashing columns and empty tables pass through every stage."""
    d, docs, _ = made
    rows = [(1, None, "x", "spans", 0), (2, "", None, None, None), (3, "same words here in this text of ten words or so", "en", "a", 5), (3, "same words here in this text of ten words or so", "en", "a", 5), (None, "no id at all, but a text", "en", "a", 1), (4, "x" * 3000, "en", "b", 3000)]
    table = spark.createDataFrame([(*r, "s", 1, True, ["q"]) for r in rows], COLUMNS + ", spans string, n int, contaminated boolean, keys array<string>")
    for name, stage in corpus_pipeline.STAGES:
        for t in (table, table.where("false")):
            out = stage(spark, t, d)
            found = out.collect()
            assert name == "pieces" or out.columns == table.columns
            assert len(found) <= len(rows) and (t is table or not found)
            if name in ("decontamination", "pieces"):
                assert t is not table or len(found) == len(rows)
