"""Mood values worked out by hand on inputs of our own; chart rows, stale symbols, candles, sinks."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsmood.operators import health, mood, series
from newsmood.sources import sinks
from tests.conftest import rows

NOON = datetime(2031, 3, 10, 12)
SIGNAL = "asset_id string, article_id string, source_id string, story_id string, stance string, strength int, status string, event_at timestamp, created_at timestamp"


def signals(spark, *votes):
    """Each vote: (source, story, stance, strength) and, if wanted, hours before noon and another asset."""
    data = []
    for n, (source, story, stance, strength, *more) in enumerate(votes):
        hours, asset = (more + [0, "kelp"][len(more):])[:2]
        status = "unclear" if stance == "unclear" else "ok"
        data.append((asset, f"note-{n}", source, story, stance, strength, status, NOON - timedelta(hours=hours), NOON + timedelta(seconds=n)))
    return spark.createDataFrame(data, SIGNAL)


def moods(spark, *votes):
    return {(r["asset_id"], str(r["day"])): r for r in rows(mood.daily_mood(signals(spark, *votes), str(NOON)))}


def only(spark, *votes):
    (got,) = moods(spark, *votes).values()
    return got


def test_three_against_one(spark):
    got = only(spark, *[(s, f"t{s}", "bearish", 3) for s in "abc"], ("d", "td", "bullish", 3))
    assert (got["score"], got["agreement"], got["confidence"], got["source_count"]) == (-0.5, 0.75, "high", 4)


def test_confidence_levels(spark):
    votes = [("a", "1", "dovish", 2), ("b", "2", "dovish", 2), ("c", "3", "hawkish", 2), ("d", "4", "hawkish", 1)]
    assert [only(spark, *votes[:n])["confidence"] for n in (1, 2, 3, 4)] == ["low", "medium", "medium", "medium"]


def test_a_source_votes_once_per_story_with_its_strongest(spark):
    got = only(spark, ("a", "t", "bullish", 1), ("a", "t", "bearish", 3), ("a", "t", "bullish", 2), ("b", "t", "bearish", 3))
    assert (got["score"], got["article_count"]) == (-1.0, 2)


def test_sources_weigh_alike_however_much_they_write(spark):
    got = only(spark, *[("loud", f"t{i}", "bullish", 3) for i in range(9)], ("calm", "x", "bearish", 3))
    assert got["score"] == 0.0 and got["article_count"] == 10


def test_strength_and_age_weigh(spark):
    assert only(spark, ("a", "1", "bullish", 3), ("b", "2", "bearish", 2))["score"] == pytest.approx(0.2)
    assert only(spark, ("a", "1", "bullish", 0), ("b", "2", "neutral", 0))["score"] == 0
    ages = spark.createDataFrame([(h,) for h in (0, 12, 48, -5)], "h int").select(
        mood.recency_weight(F.lit(NOON) - F.make_interval(hours="h"), F.lit(NOON)).alias("w"))
    assert [round(r.w, 6) for r in ages.collect()] == [1.0, 0.707107, 0.25, 1.0]


def test_days_and_assets_are_apart_and_unclear_is_out(spark):
    got = moods(spark, ("a", "1", "bullish", 3), ("a", "2", "bearish", 3, 20), ("a", "3", "hawkish", 3, 0, "isles"), ("a", "4", "unclear", 0, 90))
    assert {k: r["score"] for k, r in got.items()} == {("kelp", "2031-03-10"): 1, ("kelp", "2031-03-09"): -1, ("isles", "2031-03-10"): 1}


def test_a_hot_story_is_one_vote(spark):
    hot = [("hot", "one", "bullish", i % 4, i / 60) for i in range(250)]
    rest = [(f"s{i % 9}", f"t{i}", ["bullish", "bearish", "neutral"][i % 3], 3) for i in range(450)]
    got = only(spark, *hot, *rest)
    assert (got["article_count"], got["source_count"]) == (451, 10)


def test_chart(spark):
    days = [date(2031, 3, d) for d in range(6, 11)]
    assets = spark.createDataFrame([("kelp",)], "asset_id string")
    prices = spark.createDataFrame([("kelp", days[0], 40.0), ("kelp", days[3], 50.0), ("kelp", date(2031, 1, 1), 1.0)], "asset_id string, day date, close double")
    scores = spark.createDataFrame([("kelp", days[1], 0.25, "medium")], "asset_id string, day date, score double, confidence string")
    timeline = spark.createDataFrame([("kelp", days[1], s) for s in ("hawkish", "bullish", "neutral", "dovish")], "asset_id string, day date, stance string")
    chart = series.chart_rows(assets, prices, scores, timeline, str(NOON), days=5)
    got = rows(chart, "day")
    assert [r["day"] for r in got] == days and [r["close"] for r in got] == [40, None, None, 50, None]
    assert [(r["signals"], r["net"]) for r in got] == [(0, 0), (4, 1), (0, 0), (0, 0), (0, 0)]
    assert series.price_change(chart).first().change_pct == pytest.approx(25)
    assert series.price_change(chart.where(F.col("day") > F.lit(days[2]))).first().change_pct is None


def test_symbols_longest_without_a_price_come_first(spark):
    data = [("reef", date(2031, 3, 9)), ("quay", date(2031, 2, 1)), ("mast", None), ("today", date(2031, 3, 10)), ("dock", date(2031, 3, 8))]
    tracked = spark.createDataFrame(data, "slug string, last_day date")
    assert [r.slug for r in series.pick_stale(tracked, str(NOON), 3).collect()] == ["mast", "quay", "dock"]


def test_candles(spark):
    bad = {"low above high": ("5", "5", "6", "5"), "no close": ("5", "6", "4", "0"), "words": ("five", "6", "4", "5"), "null": (None, "6", "4", "5"),
           "infinite": ("5", "Infinity", "4", "5"), "not a number": ("NaN", "6", "4", "5")}
    good = {"plain": ("5", "6", "4", "5.5"), "exponent": ("5e0", "0.6e1", "4.", "5")}
    data = [("1899763200", *v, k) for k, v in (bad | good).items()]
    raw = spark.createDataFrame(data, "epoch string, open string, high string, low string, close string, name string")
    got = series.valid_candles(raw).withColumn("day", series.candle_day(F.col("epoch"))).collect()
    assert len(got) == len(good) and {r.day for r in got} == {date(2030, 3, 15)}


def test_source_health(spark):
    data = [("fifth", True, 4), ("third", True, 2), ("same", True, 9), ("new", True, 1), ("unseen", False, 7)]
    sources = spark.createDataFrame([(s, a, "tag", "then", None, "200", n) for s, a, n in data],
        "source_id string, is_active boolean, etag string, last_modified string, last_fetched_at timestamp, last_status string, consecutive_failures int")
    outcomes = spark.createDataFrame(
        [("fifth", "error", "http_503", None, None), ("third", "error", "timeout", None, None), ("same", "not_modified", "304", "no", "no"), ("new", "ok", "200", "tag2", None)],
        "source_id string, outcome string, status string, etag string, last_modified string")
    got = {r["source_id"]: (r["is_active"], r["consecutive_failures"], r["etag"]) for r in rows(health.fold_outcomes(sources, outcomes, str(NOON)))}
    assert got == {"fifth": (False, 5, "tag"), "third": (True, 3, "tag"), "same": (True, 0, "tag"), "new": (True, 0, "tag2"), "unseen": (False, 7, "tag")}


def test_writes_can_be_repeated(spark, tmp_path):
    days = [date(2031, 3, d) for d in (1, 2, 3)]
    schema = "asset_id string, day date, score double"
    first = spark.createDataFrame([("kelp", days[0], 0.1), ("kelp", days[1], 0.2), ("tin", days[1], 0.3)], schema)
    second = spark.createDataFrame([("kelp", days[1], 0.9), ("kelp", days[2], 0.4)], schema)
    keys = ["asset_id", "day"]
    read = lambda path: {(r.asset_id, r.day): r.score for r in spark.read.schema(schema).parquet(path).collect()}
    for batch in (first, second, second):
        sinks.upsert_partitions(batch, str(tmp_path / "wins"), keys, ["score"])
        sinks.append_new(batch, str(tmp_path / "stays"), keys, ["score"])
    old = {("kelp", days[0]): 0.1, ("kelp", days[1]): 0.2, ("tin", days[1]): 0.3, ("kelp", days[2]): 0.4}
    assert read(str(tmp_path / "stays")) == old and read(str(tmp_path / "wins")) == old | {("kelp", days[1]): 0.9}
