"""Keyed tables: insert-ignore by bucket, and story counts that take a batch in once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmood.sources import sinks
from newsmood.streaming import ingest
from tests.conftest import rows


def test_slices_keep_to_the_bound():
    assert sinks.key_slices({}, 10) == []
    assert sorted(b for bs, _ in sinks.key_slices({0: 3, 1: 4, 2: 3, 3: 10}, 10) for b in bs) == [0, 1, 2, 3]
    for counts, most in (({i: i for i in range(1, 40)}, 50), ({0: 1001, 1: 5}, 100)):
        for buckets, parts in sinks.key_slices(counts, most):
            assert sum(counts[b] for b in buckets) <= most * parts and (parts == 1 or len(buckets) == 1)


@pytest.mark.parametrize("most", [500_000, 7])
def test_only_unseen_keys_are_appended(spark, tmp_path, most):
    """Also with so few keys at a time that every bucket is read in several parts."""
    path = str(tmp_path / "t")
    batch = lambda ids, tag: spark.createDataFrame([(i if i % 7 else None, tag) for i in ids], "k long, tag string")
    for ids, tag in ((range(1, 400), "a"), (range(200, 600), "b"), (range(200, 600), "c"), ([], "d")):
        sinks.append_new(batch([*ids, *ids], tag), path, ["k"], ["tag"], buckets=8, most=most)
    got = spark.read.parquet(path).where("k IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d")).collect()
    wanted = {"a": [i for i in range(1, 400) if i % 7], "b": [i for i in range(400, 600) if i % 7]}
    assert {r.tag: (r.n, r.d) for r in got} == {t: (len(w), len(w)) for t, w in wanted.items()}


def test_stored_rows_are_not_shuffled_and_only_touched_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(spark.range(5000).withColumnRenamed("id", "k"), path, ["k"], ["k"])
    batch = sinks.with_bucket(spark.createDataFrame([(5,), (77,), (9999,)], "k long"), ["k"]).cache()
    stored = sinks.read_table(spark, path, "k long, key_bucket int")
    found = sinks.stored_keys(batch, stored, ["k"])
    assert {r.k for r in found.collect()} == {5, 77}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    touched = {r.key_bucket for r in batch.collect()}
    assert "PartitionFilters: [" in scan and "key_bucket" in scan and all(str(b) in scan for b in touched)
    # Between the scan and the join there is no exchange: the keys of the batch are broadcast.
    above = plan[: plan.index(scan)]
    assert "BroadcastHashJoin" in above and "Exchange" not in above[above.rindex("BroadcastHashJoin"):]


T0 = datetime(2031, 3, 4)


def test_story_counts_take_a_batch_in_once(spark, tmp_path):
    path = str(tmp_path / "counts")
    articles = lambda *rows: spark.createDataFrame([(*r, T0, T0) for r in rows], "story_id string, source_id string, published_at timestamp, fetched_at timestamp")
    counted = lambda: {(r["story_id"], r["source_id"]): r["article_count"] for r in rows(sinks.read_table(spark, path, ingest.COUNTS))}
    first, second = articles(("s", "a"), ("s", "a"), ("s", "b"), ("t", None)), articles(("s", "a"), ("u", "c"))
    ingest.count_stories(first, path, 0)
    ingest.count_stories(first, path, 0)
    assert counted() == {("s", "a"): 2, ("s", "b"): 1, ("t", None): 1}
    ingest.count_stories(second, path, 1)
    ingest.count_stories(second, path, 1)
    ingest.count_stories(first, path, 0)
    assert counted() == {("s", "a"): 3, ("s", "b"): 1, ("t", None): 1, ("u", "c"): 1}
    ingest.count_stories(articles(("u", "c")), path)
    assert counted()["u", "c"] == 2


def test_current_stories_of_some_ids(spark, tmp_path):
    tables = str(tmp_path)
    heads = spark.createDataFrame([(f"s{i}", f"h{i}", T0) for i in range(30)], ingest.HEADS)
    sinks.append_new(heads, f"{tables}/story_heads", ["story_id"], ["first_seen_at"])
    rows_of = spark.createDataFrame([(f"s{i}", f"src{k}", T0, T0) for i in range(30) for k in range(3)], "story_id string, source_id string, published_at timestamp, fetched_at timestamp")
    ingest.count_stories(rows_of, f"{tables}/story_counts", 0)
    some = ingest.current_stories(spark, tables, spark.createDataFrame([("s3",), ("s7",), ("none",)], "story_id string"))
    assert [(r["story_id"], r["headline"], r["article_count"], r["source_count"]) for r in rows(some, "story_id")] == [("s3", "h3", 3, 3), ("s7", "h7", 3, 3)]
    assert ingest.current_stories(spark, tables).count() == 30
