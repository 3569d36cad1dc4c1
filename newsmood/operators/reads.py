"""Read models: stories, signals, rankings and statistics for all assets at once.

Where a page would hold a nested list, the model here is a long table with the columns to order
by, so no story and no asset has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers
from newsmood.operators import detect


def source_name() -> Column:
    return F.coalesce("source_name", F.lit(config.UNKNOWN_SOURCE))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `source`, the name of the source, or "Unknown source"."""
    named = sources.select("source_id", F.col("name").alias("source_name"))
    return rows.join(named, "source_id", "left").withColumn("source", source_name()).drop("source_name")


def cited_articles(article_ids: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of a list of ids (column article_id, repeats allowed) with their source."""
    wanted = articles.join(article_ids.select("article_id").distinct(), "article_id", "left_semi")
    return with_source(wanted, sources).select(
        "article_id", "title", "url", "source", numbers.event_time().alias("published_at")
    )


def asset_stories(
    mentions: DataFrame, articles: DataFrame, stories: DataFrame, signals: DataFrame, sources: DataFrame,
    as_of, limit: int | None, hours: int = 48,
) -> DataFrame:
    """The `limit` most covered stories of every asset by arrival window (None: all), one row per article.

    Columns: asset_id, story_rank, story_key, headline, counts, last_at and the article with its
    signal. Order by asset_id, story_rank, event_at descending to show it. Stories are ranked on
    their aggregate, so their articles are never gathered in one row or one task.
    """
    since = numbers.hours_before(numbers.instant(as_of), hours)
    recent = articles.where(F.col("fetched_at") >= since).select(
        "article_id", "title", "url", "source_id", "story_id", numbers.event_time().alias("event_at")
    )
    told = stories.select(
        "story_id", F.col("headline").alias("story_headline"), F.col("article_count").alias("story_articles"),
        F.col("source_count").alias("story_sources"),
    )
    rows = (
        mentions.select("asset_id", "article_id")
        .join(recent, "article_id")
        .join(told, "story_id", "left")
        .withColumn(
            "story_key", F.coalesce("story_id", F.concat(F.lit("article:"), F.col("article_id").cast("string")))
        )
    )
    groups = rows.groupBy("asset_id", "story_key").agg(
        F.max("event_at").alias("last_at"),
        F.coalesce(F.max("story_sources"), F.lit(1).cast("long")).alias("source_count"),
        F.coalesce(F.max("story_articles"), F.lit(1).cast("long")).alias("article_count"),
        F.coalesce(F.max("story_headline"), F.min_by("title", "article_id")).alias("headline"),
    )
    rank = F.row_number().over(
        Window.partitionBy("asset_id").orderBy(F.desc("source_count"), F.desc("last_at"), F.asc("story_key"))
    )
    top = groups.withColumn("story_rank", rank)
    top = top if limit is None else top.where(F.col("story_rank") <= limit)
    scored = signals.select("asset_id", "article_id", "stance", "strength", "status")
    kept = rows.select("asset_id", "story_key", "article_id", "title", "url", "source_id", "event_at")
    return with_source(
        kept.join(top, ["asset_id", "story_key"]).join(scored, ["asset_id", "article_id"], "left"), sources
    ).drop("source_id")


def signals_with_evidence(
    signals: DataFrame, mentions: DataFrame, articles: DataFrame, sources: DataFrame, as_of,
    per_asset: int | None, days: int = 7,
) -> DataFrame:
    """The `per_asset` newest signals of every asset by arrival window (None: all), with article, source and sentences."""
    since = numbers.days_before(numbers.instant(as_of), days)
    recent = articles.where(F.col("fetched_at") >= since).select(
        "article_id", "title", "url", "source_id", numbers.event_time().alias("event_at")
    )
    newest = F.row_number().over(
        Window.partitionBy("asset_id").orderBy(F.desc("created_at"), F.asc("article_id"))
    )
    top = signals.join(recent, "article_id")
    if per_asset is not None:
        top = top.withColumn("position", newest).where(F.col("position") <= per_asset).drop("position")
    evidence = mentions.select("article_id", "asset_id", "sentences")
    return with_source(top, sources).drop("source_id").join(evidence, ["article_id", "asset_id"], "left").withColumn(
        "sentences", F.coalesce("sentences", F.array().cast(mentions.schema["sentences"].dataType))
    )


def latest_receipt(
    signals: DataFrame, mentions: DataFrame, articles: DataFrame, sources: DataFrame, assets: DataFrame, as_of,
    hours: int = 48,
) -> DataFrame:
    """The newest strong directional signal with its asset and sentences: one row or none."""
    since = numbers.hours_before(numbers.instant(as_of), hours)
    strong = signals.where(
        (F.col("status") == "ok") & F.col("stance").isin(config.DIRECTIONAL) & (F.col("strength") >= 2)
    )
    recent = articles.where(F.col("fetched_at") >= since).select(
        "article_id", "title", "url", "source_id", numbers.event_time().alias("event_at")
    )
    newest = (
        strong.join(recent, "article_id").orderBy(F.desc("created_at"), "article_id", "asset_id").limit(1)
    )
    named = assets.select("asset_id", "slug", "name", "asset_type")
    evidence = mentions.select("article_id", "asset_id", "sentences")
    return (
        with_source(newest, sources).drop("source_id").join(named, "asset_id")
        .join(evidence, ["article_id", "asset_id"], "left")
        .withColumn("sentences", F.coalesce("sentences", F.array().cast(mentions.schema["sentences"].dataType)))
    )


def active_assets(assets: DataFrame, signals: DataFrame, as_of, hours: int = 48, days: int = 7) -> DataFrame:
    """Every asset with its recent signal count and last scored stance, busiest first.

    `signals` carry event_at and fetched_at of their article; failed ones do not count.
    """
    now = numbers.instant(as_of)
    clear = F.col("stance") != "unclear"
    latest = F.struct("event_at", "created_at", "article_id")
    per_asset = (
        signals.where((F.col("status") != "failed") & (F.col("fetched_at") >= numbers.days_before(now, days)))
        .groupBy("asset_id")
        .agg(
            F.count_if(F.col("fetched_at") >= numbers.hours_before(now, hours)).alias("signals"),
            F.max_by("stance", F.when(clear, latest)).alias("last_stance"),
            F.max(F.when(clear, F.col("event_at"))).alias("last_at"),
        )
    )
    return (
        assets.join(per_asset, "asset_id", "left")
        .withColumns(
            {
                "signals": F.coalesce("signals", F.lit(0).cast("long")),
                "last_stance": F.when(F.col("last_at").isNotNull(), F.col("last_stance")),
            }
        )
        .orderBy(F.desc("signals"), F.desc_nulls_last("last_at"), "asset_id")
    )


def site_stats(sources: DataFrame, articles: DataFrame, assets: DataFrame, signals: DataFrame, as_of) -> DataFrame:
    """Counts for the front page as (metric, value) rows; last_updated is in epoch seconds."""
    since = numbers.days_before(numbers.instant(as_of), 1)
    one = lambda df, name, value: df.agg(value.alias("value")).select(F.lit(name).alias("metric"), "value")
    count = F.count("*")
    return (
        one(sources.where("is_active"), "sources", count)
        .unionByName(one(articles.where(F.col("fetched_at") >= since), "articles_24h", count))
        .unionByName(one(assets, "assets", count))
        .unionByName(one(signals.where(F.col("created_at") >= since), "signals_24h", count))
        .unionByName(one(sources, "last_updated", F.unix_seconds(F.max("last_fetched_at"))))
    )


def any_signal(signals: DataFrame) -> DataFrame:
    """One row: whether at least one signal exists; reads no more than one row."""
    return signals.limit(1).agg((F.count("*") > 0).alias("has_signals"))


def watchlists_in_order(watchlists: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets of every user's watchlist with their position in the order they were added."""
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("added_at", "asset_id"))
    return (
        watchlists.withColumn("position", position)
        .join(assets.select("asset_id", "slug", "name", "asset_type"), "asset_id")
    )


def beginner_flags(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Beginner mode of every user, false without a stored setting."""
    return users.select("user_id").distinct().join(settings, "user_id", "left").select(
        "user_id", F.coalesce("beginner_mode", F.lit(False)).alias("beginner_mode")
    )


def article_evidence(
    mentions: DataFrame, assets: DataFrame, signals: DataFrame, article_id=None, slugs: list[str] | None = None
) -> DataFrame:
    """Evidence blocks: sentences of a mention and its signal, for one article or for all."""
    keys = ["article_id", "asset_id"]
    wanted = mentions if article_id is None else mentions.where(F.col("article_id") == article_id)
    blocks = (
        wanted.select(*keys, "sentences")
        .join(assets.select("asset_id", "slug", "name"), "asset_id", "left")
        .join(signals.select(*keys, "stance", "strength", "status", "why", "evidence_ids"), keys, "left")
        .withColumns(
            {
                "slug": F.coalesce("slug", F.lit("")),
                "name": F.coalesce("name", F.lit("Asset")),
                "why": F.coalesce("why", F.lit("")),
                "evidence_ids": F.coalesce("evidence_ids", F.array().cast("array<string>")),
            }
        )
    )
    return blocks.where(F.col("slug").isin(slugs)) if slugs else blocks


def cited_texts(blocks: DataFrame) -> DataFrame:
    """Adds the cited sentences and all sentences with a cited flag."""
    return blocks.withColumns(
        {
            "cited": detect.cited_sentences(F.col("sentences"), F.col("evidence_ids")),
            "flagged": detect.flag_cited(F.col("sentences"), F.col("evidence_ids")),
        }
    )


def last_scored(signals: DataFrame) -> DataFrame:
    """The last signal of each asset that is neither failed nor unclear, by event time."""
    scored = signals.where("status <> 'failed' AND stance <> 'unclear'")
    latest = F.struct("event_at", "created_at", "article_id")
    return scored.groupBy("asset_id").agg(
        F.max_by(F.struct("article_id", "stance", "strength", "event_at"), latest).alias("last")
    ).select("asset_id", "last.*")


def own_rows(table: DataFrame, user_id) -> DataFrame:
    """What one user may read of a private table: the own rows only."""
    return table.where(F.col("user_id") == user_id)


PUBLIC_TABLES = [
    "sources", "assets", "asset_aliases", "articles", "stories", "asset_mentions", "asset_signals", "daily_mood",
    "daily_prices",
]
PRIVATE_TABLES = ["watchlists", "user_settings", "briefs"]


def readable(name: str, table: DataFrame, user_id) -> DataFrame:
    """Row filter of a table for a signed-in user: news is open, operations tables are empty."""
    if name in PUBLIC_TABLES:
        return table
    if name in PRIVATE_TABLES:
        return own_rows(table, user_id)
    return table.where(F.lit(False))
