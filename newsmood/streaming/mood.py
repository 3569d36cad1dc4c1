"""Daily mood as a stream of signals, kept per (asset, day) and brought up to date where a batch touches it.

The weight of a vote is 0.5^((reference - event) / 24 h), which is a factor of the reference times one of the event. All votes of an asset's day have one
reference, so its factor cancels in the score, and the mood of a day does not change as time goes on. So a batch reads and rewrites only the days and asset buckets
of its own votes, and recomputes only their cells. The exception are votes later than the reference, which count as if they were at it: a cell that
has one is open, and is computed again by the batches that follow, until the reference has passed all of its votes.

Votes are merged by the one-vote rule: the better of two votes of a story is the same in any order and however often it comes, so a batch that is run again
after a failure changes nothing. Signals are stored last; until then a repeated batch finds them unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsmood import config
from newsmood.functions import numbers
from newsmood.operators import mood
from newsmood.session import checkpoint
from newsmood.sources import sinks

SIGNALS = (
    "article_id long, asset_id string, source_id string, story_id string, stance string, strength int, status string, "
    "event_at timestamp, created_at timestamp, created_day date"
)
VOTES = (
    "asset_id string, source_id string, story_key string, direction int, strength int, event_at timestamp, created_at timestamp, "
    "article_id long, day date, asset_bucket int"
)
MOOD = (
    "asset_id string, score double, confidence string, article_count long, source_count long, agreement double, is_open boolean, day date"
)
#: Folders of a day that assets are dealt into.
ASSET_BUCKETS = 16


def _bucket(asset_id: str = "asset_id"):
    return F.pmod(F.xxhash64(asset_id), F.lit(ASSET_BUCKETS)).cast("int")


def merge_votes(new: DataFrame, path: str) -> None:
    """Adds votes to the stored ones by the one-vote rule, rewriting only the folders (day, asset bucket) of the new votes."""
    new = checkpoint(new.withColumn("asset_bucket", _bucket()).select(*[F.col(c).cast(t) for c, t in (x.split() for x in VOTES.split(", "))]))
    folders = new.select("day", "asset_bucket").distinct()
    stored = _votes_in(new.sparkSession, path, folders)
    merged = mood.best_votes(stored.unionByName(new))
    dealt = checkpoint(merged).repartition("day", "asset_bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "asset_bucket").parquet(path)


def _votes_in(spark, path: str, folders: DataFrame) -> DataFrame:
    """The stored votes of some folders (`day`, `asset_bucket`); no other is read. Folders are few: days of the window times ASSET_BUCKETS."""
    known: dict = {}
    for r in folders.collect():
        known.setdefault(r["day"], []).append(r["asset_bucket"])
    inside = F.lit(False)
    for day, buckets in sorted(known.items()):
        inside = inside | ((F.col("day") == F.lit(day)) & F.col("asset_bucket").isin(buckets))
    return sinks.read_table(spark, path, VOTES).where(inside)


def mood_batch(signals: DataFrame, tables: str, as_of) -> None:
    """Stores new signals, merges their votes and upserts the mood of the cells that they touch, and of open ones, in the last days."""
    spark, now = signals.sparkSession, numbers.instant(as_of)
    dated = signals.withColumn("created_day", F.to_date("created_at")).select(*sinks.column_names(SIGNALS))
    new = sinks.not_stored(dated, f"{tables}/signals", ["article_id", "asset_id"], ["created_at"])
    since = numbers.days_before(now, config.MOOD_DAYS + config.MOOD_READ_MARGIN_DAYS)
    first, last = F.date_sub(F.to_date(now), config.MOOD_DAYS - 1), F.to_date(now)
    fresh = checkpoint(mood.votes(mood.usable_signals(new.where(F.col("created_at") >= since))).where(F.col("day") >= first))
    merge_votes(fresh, f"{tables}/votes")
    # Votes of days to come wait for their day.
    fresh.where(F.col("day") > last).select("asset_id", "day").distinct().write.mode("append").partitionBy("day").parquet(f"{tables}/waiting")

    in_window = F.col("day").between(first, last)
    stored = sinks.read_table(spark, f"{tables}/daily_mood", MOOD).where(in_window).select("asset_id", "day", "is_open")
    waiting = sinks.read_table(spark, f"{tables}/waiting", "asset_id string, day date").where(in_window).join(stored, ["asset_id", "day"], "left_anti")
    cells = fresh.where(in_window).select("asset_id", "day").union(stored.where("is_open").select("asset_id", "day")).union(waiting.select("asset_id", "day"))
    cells = checkpoint(cells.distinct().withColumn("asset_bucket", _bucket()))
    votes = _votes_in(spark, f"{tables}/votes", cells.select("day", "asset_bucket").distinct()).join(cells.drop("asset_bucket"), ["asset_id", "day"], "left_semi")
    votes = checkpoint(votes)
    later = votes.groupBy("asset_id", "day").agg((F.max("event_at") > now).alias("is_open"))
    recent = mood.mood_from_votes(votes, as_of).join(later, ["asset_id", "day"])
    sinks.upsert_partitions(recent.select(*sinks.column_names(MOOD)), f"{tables}/daily_mood", ["asset_id", "day"], ["score"], partition_by="day")
    sinks.append_rows(new, f"{tables}/signals", ["article_id", "asset_id"])


def start_mood(signals: DataFrame, tables: str, as_of, progress: str) -> StreamingQuery:
    return (
        signals.writeStream.foreachBatch(lambda batch, _: mood_batch(batch, tables, as_of))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
