"""Snapshots absorbed one by one, in every order, against the merge of all at once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pacelake.operators import snapshot
from pacelake.streaming import incremental

SCHEMA = "dataset string, canonical_key string, snapshot_id string, export_observed_at string, source_relative_path string, source_record_index string, record map<string,string>"


def rows(days=(1, 2, 3, 4)):
    dice, out = random.Random(5), []
    for day in days:
        for key in range(30):
            if dice.random() < 0.3:
                continue
            record = {"a": dice.choice(["1", "2", "null", '""']), "b": str(day)} if key % 3 else {"a": "1"}
            if dice.random() < 0.5:
                record["c"] = dice.choice(["null", "[]", '"x"'])
            dataset = ["activities", "uds_daily", "sleep_daily"][key % 3]
            for copy in range(dice.choice([1, 1, 2, 11])):
                odd = key == 7 and copy == 1
                out.append((dataset, None if key == 11 else f"{dataset}:{key}", f"s{day}", f"2024-01-0{day}", "f.json", str(copy), record | ({"d": "1"} if odd else {})))
    return out


def rules():
    return F.col("dataset") != "activities", F.col("dataset") == "uds_daily"


def told(tables):
    """Every table of a merge as sorted rows."""
    out = {}
    for name in ("canonical", "conflicts", "variants", "field_provenance", "patterns", "summary"):
        df = tables[name]
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else c for c, t in df.dtypes])
        out[name] = sorted(df.select(*sorted(df.columns)).collect(), key=str)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def batch_merge(table):
    return told(snapshot.merge_observations(table.withColumn("logical_order", F.substring("snapshot_id", 2, 1).cast("long")), 4, *rules()))


def test_every_table_has_rows(batch_merge):
    assert all(batch_merge.values()) and {r["conflict_type"] for r in batch_merge["conflicts"]} == {"divergent_duplicate_within_snapshot", "same_stable_key_different_public_value"}


def test_all_orders_of_four_snapshots_agree(spark, table, batch_merge, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # small tables, many jobs
    for k, order in enumerate(itertools.permutations((1, 2, 3, 4))):
        path = f"file://{tmp_path}/{k}"
        for n, day in enumerate(order):
            incremental.absorb(table.where(F.col("snapshot_id") == f"s{day}"), n, path)
        found = incremental.current(spark, path, *rules())
        if k % 12 == 5:
            assert told(found) == batch_merge, order
            continue
        got = found["canonical"].withColumn("raw_record", F.to_json("raw_record"))
        assert sorted(got.select(*sorted(got.columns)).collect(), key=str) == batch_merge["canonical"], order
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_parts_of_a_snapshot_repeated_batches_and_compaction(spark, table, batch_merge, tmp_path):
    path = f"file://{tmp_path}/state"
    parts = table.randomSplit([1.0] * 5, seed=3)
    for n, part in enumerate(parts):
        incremental.absorb(part, n, path)
        incremental.absorb(part, n, path)  # a batch that runs again
        if n == 2:
            incremental.compact(spark, path)
            incremental.absorb(part, n, path)  # and once more after it has been put into the base
    assert told(incremental.current(spark, path, *rules())) == batch_merge
    incremental.compact(spark, path)
    incremental.compact(spark, path)
    assert told(incremental.current(spark, path, *rules())) == batch_merge


def test_stream_with_a_late_early_snapshot(spark, table, batch_merge, tmp_path):
    """Files come in the order 4, 2, 1, 3; the stream is stopped and started in between."""
    source, path, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint"
    for day in (4, 2, 1, 3):
        table.where(F.col("snapshot_id") == f"s{day}").coalesce(1).write.mode("append").parquet(source)
        query = incremental.stream(spark.readStream.schema(table.schema).parquet(source), path, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    assert told(incremental.current(spark, path, *rules())) == batch_merge


def test_nothing_absorbed_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        incremental.state(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("name", ["summary", "patterns"])
def test_counters_and_patterns_read_observations_once_and_sort_by_keys_only(table, name):
    found = snapshot.merge_observations(table.withColumn("logical_order", F.substring("snapshot_id", 2, 1).cast("long")), 4, *rules())[name]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 3 and "explode" not in plan


def test_provenance_lists_every_observation_without_exploding_fields(spark):
    rows = [("a", "k", "s1", 1, "t1", "f", "0", {"x": "1", "y": "null"}), ("a", "k", "s1", 1, "t1", "f", "0", {"x": "1", "y": "null"}), ("a", "k", "s2", 2, "t2", "f", "0", {"x": "2"}), ("a", "k", "s3", 3, "t3", "f", "9", {"z": "[]", "x": "null"})]
    rows = spark.createDataFrame(rows, "dataset string, canonical_key string, snapshot_id string, logical_order long, export_observed_at string, source_relative_path string, source_record_index string, record map<string,string>")
    found = snapshot.merge_observations(rows, 3)["provenance"]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.snapshot_id, r.merge_disposition) for r in found.collect()) == [("s1", "field_contributor"), ("s1", "field_contributor"), ("s2", "field_contributor"), ("s3", "field_contributor")]


def test_stable_json_quotes_names_without_patterns(spark):
    made = spark.createDataFrame([({'a"\\': "1", "b": '"x"'},)], "record map<string,string>").select(snapshot.stable_json("record").alias("json"))
    assert made.first().json == '{"a\\"\\\\":1,"b":"x"}' and "regexp" not in made._jdf.queryExecution().analyzed().toString()
