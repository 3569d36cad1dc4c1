"""Feed ingest as a stream: landed files to articles, story heads and mentions.

Every write is keyed and insert-ignore, and ids are derived from the URL, so a batch that is run
again after a failure adds nothing twice. The articles are written last: until then a repeated
batch finds its items still unseen and completes what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsmood import config
from newsmood.functions import numbers
from newsmood.operators import clean, detect, stories
from newsmood.operators.dedupe import unseen
from newsmood.session import checkpoint
from newsmood.sources import feeds, sinks

ARTICLES = (
    "article_id string, source_id string, url string, url_hash string, title string, body string, excerpt string, "
    "published_at timestamp, fetched_at timestamp, story_id string"
)
HEADS = "story_id string, headline string, first_seen_at timestamp"
POOL = "article_id string, story_id string, title string, published_at timestamp, fetched_at timestamp, fetched_day date"
COUNTS = (
    "story_id string, source_id string, article_count long, first_seen_at timestamp, last_seen_at timestamp, upto long, story_bucket int"
)


def read_landing(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of raw items from RSS and Atom files landed in one folder per source, `source_id=<id>`."""
    return feeds.stream_feeds(spark, folder, files_per_batch, "source_id string").drop("feed_file")


def ingest_batch(items: DataFrame, tables: str, aliases: DataFrame, as_of, number: int | None = None) -> None:
    """One run over a batch of raw items (source_id, title, link, summary, date), in the order of the feeds.

    What is read follows the batch: the key buckets and story buckets that it touches, and the recent pool's days. `number` is the stream's number of the
    batch; with it a batch that is run again after a failure counts nothing twice.
    """
    spark = items.sparkSession
    good = clean.accepted(clean.normalise_items(items.withColumn("position", F.monotonically_increasing_id()), as_of))
    fresh = sinks.not_stored(good, f"{tables}/articles", ["url_hash"], ["source_id", "position"])
    fresh = fresh.withColumns({"article_id": F.col("url_hash"), "fetched_at": numbers.instant(as_of)})
    if fresh.isEmpty():
        return
    new = fresh.select("article_id", "title", numbers.event_time().alias("at"))
    since = F.to_date(numbers.hours_before(numbers.instant(as_of), config.STORY_POOL_HOURS))
    pool = sinks.read_table(spark, f"{tables}/pool", POOL).where(F.col("fetched_day") >= since)
    # A batch that is run again finds itself in the pool.
    pool = unseen(pool, fresh, ["article_id"]).dropDuplicates(["article_id"])
    assigned = checkpoint(stories.assign_stories(new, stories.recent_pool(pool, as_of)))
    heads = stories.new_story_rows(assigned, new).select("story_id", "headline", "first_seen_at")
    sinks.append_new(heads, f"{tables}/story_heads", ["story_id"], ["first_seen_at"])
    mentions = detect.mention_rows(fresh, aliases)
    sinks.append_new(mentions, f"{tables}/mentions", ["article_id", "asset_id"], ["article_id"])
    rows = checkpoint(fresh.join(assigned.select("article_id", "story_id"), "article_id").select(*sinks.column_names(ARTICLES)))
    count_stories(rows, f"{tables}/story_counts", number)
    recent = rows.withColumn("fetched_day", F.to_date("fetched_at")).select(*sinks.column_names(POOL))
    recent.write.mode("append").partitionBy("fetched_day").parquet(f"{tables}/pool")
    sinks.append_rows(rows, f"{tables}/articles", ["url_hash"])


def count_stories(articles: DataFrame, path: str, number: int | None = None) -> None:
    """Adds new articles to the counts per story and source, rewriting only the buckets of their stories.

    One row per story and source makes the number of a story's sources exact. A row knows the last batch that it took in (`upto`), so a batch
    that comes again after a failure leaves the rows that it reached alone.
    """
    at = numbers.event_time()
    bucket = F.pmod(F.xxhash64("story_id"), F.lit(sinks.KEY_BUCKETS)).cast("int").alias("story_bucket")
    new = articles.groupBy("story_id", "source_id").agg(F.count("*").alias("article_count"), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
    new = checkpoint(new.select("*", F.lit(number).cast("long").alias("upto"), bucket).select(*sinks.column_names(COUNTS)))
    touched = [r["story_bucket"] for r in new.select("story_bucket").distinct().collect()]
    stored = sinks.read_table(articles.sparkSession, path, COUNTS).where(F.col("story_bucket").isin(touched))
    both = stored.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
    same = Window.partitionBy("story_bucket", "story_id", "source_id")
    counted = both.withColumn("done", F.max(F.when(~F.col("is_new"), F.col("upto"))).over(same)).where(
        ~F.col("is_new") | F.col("upto").isNull() | F.col("done").isNull() | (F.col("upto") > F.col("done")))
    merged = counted.groupBy("story_bucket", "story_id", "source_id").agg(
        F.sum("article_count").alias("article_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("upto").alias("upto"))
    checkpoint(merged.select(*sinks.column_names(COUNTS))).repartition("story_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("story_bucket").parquet(path)


def start_ingest(items: DataFrame, tables: str, aliases: DataFrame, as_of, progress: str) -> StreamingQuery:
    """Processes what has landed since the last run and stops; `progress` keeps the position."""
    return (
        items.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, tables, aliases, as_of, number))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def current_stories(spark: SparkSession, tables: str, story_ids: DataFrame | None = None) -> DataFrame:
    """Stories with their counts as of now, from heads and counts; all, or those given, for which only their buckets are read."""
    counts = sinks.read_table(spark, f"{tables}/story_counts", COUNTS)
    heads = sinks.read_table(spark, f"{tables}/story_heads", HEADS + ", key_bucket int")
    if story_ids is not None:
        # Both tables are dealt by the hash of the story.
        wanted = checkpoint(sinks.with_bucket(story_ids.select("story_id").distinct(), ["story_id"]))
        touched = [r["key_bucket"] for r in wanted.select("key_bucket").distinct().collect()]
        counts = counts.where(F.col("story_bucket").isin(touched)).join(wanted.select("story_id"), "story_id", "left_semi")
        heads = heads.where(F.col("key_bucket").isin(touched))
    totals = counts.groupBy("story_id").agg(
        F.sum("article_count").alias("article_count"), F.count("*").alias("source_count"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return heads.select("story_id", "headline").join(totals, "story_id")


def drop_late_and_seen(items: DataFrame, as_of) -> DataFrame:
    """A stream of accepted items, each URL once within the seven days in which items may arrive.

    Items without a date count as of `as_of`. The watermark bounds the state; the exact rule for
    old items is the filter of the cleaning step, and the exact rule for repeats is the key check
    against the stored table.
    """
    good = clean.accepted(clean.normalise_items(items, as_of))
    dated = good.withColumn("event_at", F.coalesce("published_at", numbers.instant(as_of)))
    return dated.withWatermark("event_at", f"{config.MAX_AGE_DAYS} days").dropDuplicatesWithinWatermark(["url_hash"])
