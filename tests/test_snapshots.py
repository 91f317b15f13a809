"""The queries over snapshots against brute force, on a history of more weeks than a word has bits."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pacelake.operators import coverage, digest, snapshot
from pacelake.plans import queries

FLAGS = ("^0*1$", "0$", "10+1")


@pytest.fixture(scope="module", params=[6, 70])
def history(spark, request, tmp_path_factory):
    """A folder with events of so many weeks (one week without any between them), and what each key was last seen with in each."""
    weeks, dice = request.param, random.Random(request.param)
    rows = []
    for w in range(weeks):
        for user in range(12):
            if user == w % 12 or dice.random() < (0.03 if user < 6 else 0.5):
                rows += [(user, dice.choice(["click", "view"]), w, round(dice.uniform(0, 20), 2)) for _ in range(dice.choice([1, 2]))]
    start = dt.datetime(2024, 1, 1, 12)
    table = [(i, start + dt.timedelta(weeks=w + (w > 2)), u, t, v, "{}") for i, (u, t, w, v) in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(folder + "/events.parquet")
    seen = defaultdict(dict)
    for i, (u, t, w, v) in enumerate(rows):
        seen[u, t][w] = (i, v if v >= 5 else None)
    return folder, weeks, seen, {k: "".join("01"[w in s] for w in range(weeks)) for k, s in seen.items()}


def run(spark, folder, name):
    return [tuple(r) for r in queries.queries()[name](spark, folder).collect()]


def test_patterns_and_merge(spark, history):
    folder, _, seen, pattern = history
    flags = {p: tuple(bool(re.search(f, p)) for f in FLAGS) for p in pattern.values()}
    assert sorted(run(spark, folder, "presence_patterns_events")) == sorted((*k, p, p.count("1"), *flags[p]) for k, p in pattern.items())
    assert sorted(run(spark, folder, "presence_histogram_events")) == sorted(Counter(pattern.values()).items())
    want = set()
    for k, s in seen.items():
        known = [v for _, (_, v) in sorted(s.items()) if v is not None]
        want.add((*k, known[-1] if known else None, s[max(s)][0], pattern[k], len(s), len(s), *flags[pattern[k]]))
    assert set(run(spark, folder, "snapshot_merge_events")) == want


def test_coverage(spark, history):
    folder, weeks, _, pattern = history
    keys = list(pattern.values())
    first = Counter(p.index("1") + 1 for p in keys)
    assert sorted(run(spark, folder, "coverage_prefix_events")) == [(n, first[n], sum(first[m] for m in range(1, n + 1))) for n in range(1, weeks + 1)]
    assert sorted(run(spark, folder, "coverage_leave_one_out")) == [(n, sum(p.count("1") == 1 and p[n - 1] == "1" for p in keys)) for n in range(1, weeks + 1)]
    want = []
    for left in range(1, weeks + 1):
        for right in range(left + 1, weeks + 1):
            n = Counter((p[left - 1], p[right - 1]) for p in keys)
            both, one, other = n["1", "1"], n["1", "0"], n["0", "1"]
            want.append((left, right, both + one, both + other, both, one, other))
    assert sorted(run(spark, folder, "coverage_pairwise_events")) == want


def test_orders_outside_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y")], "k string, n long, v string")
    for made in (coverage.presence(rows, ["k"], "n", 2), snapshot.merge_fields(rows, ["k"], ["v"], "n", 2)):
        with pytest.raises(Exception, match="not one of the 2"):
            made.collect()


def test_build_digest_of_many_records_is_that_of_one_sequence(spark):
    """More records than a leaf of a hash tree holds."""
    n = digest.LEAF_ROWS + 1000
    records = spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("canonical_key"), F.lit("r").alias("record_sha256"), F.lit("1").alias("presence_pattern"))
    variants = spark.createDataFrame([], "dataset string, canonical_key string, signature string, snapshot_orders string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    leaf = lambda texts: sha("\n".join(sorted(map(sha, texts))))
    want = sha("\n".join(['["v=1"]', leaf(f'["d","{k}","r","1"]' for k in range(n)), leaf(["c"])]))
    assert tuple(digest.build_digest(records, variants, spark.createDataFrame([("c",)], "content_id string"), {"v": "1"}).first()) == (n, 1, want)
    none = digest.build_digest(records.where("false"), variants, spark.createDataFrame([("c",)], "content_id string"), {"v": "1"}).first()
    assert tuple(none) == (0, 1, sha('["v=1"]\n\n' + leaf(["c"])))


def test_patterns_are_those_of_merged_keys_without_sorting_or_texts(spark):
    """Equal and different records in and across snapshots, at one time and at several, in any order of fields, and rows without a key."""
    rows, dice = [], random.Random(5)
    for k in range(120):
        for order in dice.sample((1, 2, 3), dice.randint(1, 3)):
            for _ in range(dice.randint(1, 2)):
                fields = [("a", str(dice.randrange(1 + k % 3))), ("b", "null"), ("c", '""')]
                dice.shuffle(fields)
                rows.append((f"k{k}" if k % 10 else None, f"s{order}", order, "t" if k % 4 == 0 else f"t{order}", "p", len(rows), dict(fields)))
    seen = spark.createDataFrame(rows, "canonical_key string, snapshot_id string, logical_order long, export_observed_at string, source_relative_path string, source_record_index long, record map<string,string>")
    for daily, preserve in ((False, False), (True, False), (True, True)):
        out = snapshot.merge_dataset(seen, 3, daily, preserve)
        want = Counter(r[0] for r in out["canonical"].select("presence_pattern").collect())
        assert len(want) > 2 and dict(map(tuple, out["patterns"].collect())) == want
        plan = out["patterns"]._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "StructsToJson" not in plan
