"""The as-of lookup against brute force; streams run twice add nothing."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsmood.operators.asof import first_at_or_after
from newsmood.sources import feeds
from newsmood.streaming import health, ingest, mood
from tests.conftest import rows
from tests.test_mood_and_series import NOON, signals

T0 = datetime(2031, 3, 4)


def test_first_at_or_after(spark):
    """One group holds most members, many at the same time."""
    rng = random.Random(5)
    at = lambda: T0 + timedelta(seconds=rng.choice([0, 17, 600, rng.randint(0, 90_000)]))
    members = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", at(), i) for i in range(1500)]
    asked = [(rng.choice(["hot", "g1", "g2", "none"]), at()) for _ in range(300)]
    got = first_at_or_after(
        spark.createDataFrame(members, "g string, at timestamp, id int"), spark.createDataFrame(asked, "g string, since timestamp"), ["g"]
    )
    want = {}
    for g, since in asked:
        later = [(a, i) for k, a, i in members if k == g and a >= since]
        if later:
            want[(g, since)] = min(later)
    assert {(r.g, r.since): (r.hit_at, r.hit_id) for r in got.collect()} == want


ITEM = "<item><title>{}</title><link>https://pier.test/{}</link><description>{}</description><pubDate>Sun, 09 Mar 2031 0{}:00:00 GMT</pubDate></item>"


def land(folder, source, name, *items):
    (folder / f"source_id={source}").mkdir(parents=True, exist_ok=True)
    body = "".join(ITEM.format(*i) for i in items)
    (folder / f"source_id={source}" / name).write_text(f"<rss><channel>{body}</channel></rss>")


def test_ingest_stream(spark, tmp_path):
    landing, tables, progress = tmp_path / "landing", str(tmp_path / "tables"), str(tmp_path / "progress")
    aliases = spark.createDataFrame([("kelp", "kelp", False), ("tin", "TIN", True)], "asset_id string, alias string, is_case_sensitive boolean")
    far = "Calm seas. " * 80 + "TIN was found."

    def run(as_of):
        ingest.start_ingest(ingest.read_landing(spark, str(landing), 1), tables, aliases, as_of, progress).awaitTermination()
        return [spark.read.parquet(f"{tables}/{t}").count() for t in ("articles", "story_heads", "mentions")]

    land(landing, "pier", "1.xml", ("Kelp boat sinks off north reef overnight", "a", "None hurt.", 1), ("Second words", "a", "Same link.", 1), ("Mast raised", "b", far, 2))
    assert run("2031-03-10 00:00:00") == [2, 2, 2]
    got = {r.url: r for r in spark.read.parquet(f"{tables}/articles").collect()}
    # The first item of a feed wins, the article carries its source, the body is whole.
    assert got["https://pier.test/a"].title.startswith("Kelp boat") and {r.source_id for r in got.values()} == {"pier"}
    assert got["https://pier.test/b"].body == far
    # Another source repeats one link and tells one story again.
    land(landing, "buoy", "1.xml", ("Mast raised", "b", far, 2), ("Kelp boat sinks off north reef overnight again", "c", "", 3))
    assert run("2031-03-10 02:00:00") == [3, 2, 3]
    assert run("2031-03-10 04:00:00") == [3, 2, 3]
    story = max(rows(ingest.current_stories(spark, tables)), key=lambda r: r["article_count"])
    assert (story["article_count"], story["source_count"]) == (2, 2)
    # A batch repeated after a failure adds nothing.
    items = feeds.read_feeds(spark, str(landing), "source_id string").drop("feed_file")
    ingest.ingest_batch(items, tables, aliases, "2031-03-10 06:00:00")
    assert spark.read.parquet(f"{tables}/articles").count() == 3


def test_mood_stream_recomputes_late_days(spark, tmp_path):
    tables = str(tmp_path)
    number = lambda df: df.withColumn("article_id", df.article_id.substr(6, 9).cast("long"))
    first = number(signals(spark, ("a", "1", "bullish", 3), ("b", "2", "bearish", 3, 50)))
    late = number(signals(spark, ("a", "1", "bullish", 3), ("b", "2", "bearish", 3, 50), ("c", "3", "bearish", 3, 49)))
    for batch in (first, late, late):
        mood.mood_batch(batch, tables, str(NOON))
    got = {str(r.day): r.source_count for r in spark.read.parquet(f"{tables}/daily_mood").collect()}
    assert got["2031-03-10"] == 1 and got["2031-03-08"] == 2


def test_mood_over_batches_equals_one_computation(spark, tmp_path):
    """Random batches, some repeated, with late votes, votes later than the reference and votes of days to come, as the reference moves on."""
    from newsmood.operators import mood as whole

    rng, tables = random.Random(9), str(tmp_path)
    start, signals_seen = datetime(2031, 3, 8, 6), []
    schema = ", ".join(c for c in mood.SIGNALS.split(", ") if not c.startswith("created_day"))
    for step in range(4):
        as_of = start + timedelta(hours=17 * step)
        batch = []
        for i in range(40):
            event = as_of + timedelta(minutes=rng.randint(-60 * 40, 60 * 30))
            batch.append((step * 100 + i, rng.choice("ab"), rng.choice(["s1", "s2", "s3"]), rng.choice(["t1", "t2", None]), rng.choice(["bullish", "bearish", "neutral"]),
                          rng.randint(0, 3), rng.choice(["ok", "ok", "unclear"]), event, as_of - timedelta(minutes=rng.randint(0, 50))))
        signals_seen += batch
        for _ in range(1 + step % 2):
            mood.mood_batch(spark.createDataFrame(batch, schema), tables, str(as_of))
    got = {(r.asset_id, str(r.day)): (r.score, r.confidence, r.article_count, r.source_count, r.agreement) for r in spark.read.parquet(f"{tables}/daily_mood").collect()}
    want = whole.rolling_mood(spark.createDataFrame(signals_seen, schema), str(as_of)).collect()
    assert len(want) > 6
    assert got == {(r.asset_id, str(r.day)): (r.score, r.confidence, r.article_count, r.source_count, r.agreement) for r in want}


def test_a_batch_reads_only_its_own_folders(spark, tmp_path):
    """Votes of other days and assets are neither read nor written again."""
    import os

    tables = str(tmp_path)
    number = lambda df: df.withColumn("article_id", df.article_id.substr(6, 9).cast("long"))
    mood.mood_batch(number(signals(spark, ("a", "1", "bullish", 3), ("b", "2", "bearish", 3, 50))), tables, str(NOON))
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{tables}/votes") for f in fs if f.endswith(".parquet")}
    before = files()
    late = number(signals(spark, ("a", "1", "bullish", 3), ("b", "2", "bearish", 3, 50), ("c", "3", "bearish", 3, 49)))
    mood.mood_batch(late, tables, str(NOON))
    assert len(before & files()) == len(before) - 1
    assert len(files()) == len(before)


OUTCOME = "source_id string, fetched_at timestamp, fetch_id int, outcome string"
SOURCE = "source_id string, is_active boolean, consecutive_failures long"


def test_health_over_batches_equals_one_by_one(spark, tmp_path):
    """Random outcomes in batches, each of them twice, against a loop; a source that is not stored has no effect."""
    rng, path = random.Random(8), str(tmp_path / "sources")
    start = [(f"s{i}", i % 6 != 0, i % 7) for i in range(12)]
    outcomes = [(rng.choice([s for s, *_ in start] + ["unknown"]), T0 + timedelta(minutes=rng.randint(0, 500)), k, rng.choice(["error", "error", "error", "ok", "not_modified"])) for k in range(300)]
    outcomes.sort(key=lambda r: (r[1], r[2]))
    state = {s: [active, n] for s, active, n in start}
    for source, _, _, outcome in outcomes:
        if source in state:
            state[source][1] = state[source][1] + 1 if outcome == "error" else 0
            state[source][0] = state[source][0] and not (outcome == "error" and state[source][1] >= 5)
    health._in_buckets(spark.createDataFrame(start, SOURCE).withColumn("upto", F.lit(-1).cast("long"))).write.partitionBy("source_bucket").parquet(path)
    for number, at in enumerate((0, 40, 41, 170, 300)):
        before = outcomes[(0, 0, 40, 41, 170)[number]: at]
        for _ in range(2):
            health.apply_batch(spark.createDataFrame(before, OUTCOME), path, number)
    got = {r["source_id"]: [r["is_active"], r["consecutive_failures"]] for r in rows(health.current_sources(spark, path))}
    assert got == state
    one = health.fold_batch(spark.createDataFrame(start, SOURCE), spark.createDataFrame(outcomes, OUTCOME))
    assert {r["source_id"]: [r["is_active"], r["consecutive_failures"]] for r in rows(one)} == state
