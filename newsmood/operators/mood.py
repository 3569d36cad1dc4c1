"""Daily mood per asset from validated stance signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers
from newsmood.operators.dedupe import first_per_key


def usable_signals(signals: DataFrame) -> DataFrame:
    """Signals with status ok and a direction; adds direction (+1, -1, 0)."""
    return (
        signals.where("status = 'ok'")
        .withColumn("direction", numbers.stance_value(F.col("stance")))
        .where("direction IS NOT NULL")
    )


def votes(usable: DataFrame) -> DataFrame:
    """One vote per (asset, day, source, story): strongest, then newest, then first created.

    An article without a story is its own story.
    """
    keyed = usable.withColumns(
        {
            "day": F.to_date("event_at"),
            "story_key": F.coalesce("story_id", F.concat(F.lit("article:"), F.col("article_id").cast("string"))),
        }
    )
    return best_votes(keyed)


def best_votes(keyed: DataFrame) -> DataFrame:
    """The best vote per (asset, day, source, story). Taken of two sets and then of both, it is the same as of all at once."""
    return first_per_key(
        keyed,
        ["asset_id", "day", "source_id", "story_key"],
        [F.desc("strength"), F.desc("event_at"), F.asc("created_at"), F.asc("article_id")],
    )


def recency_weight(event_at: Column, reference: Column) -> Column:
    """1 at the reference time, halving every 24 hours; later times count as 1."""
    age_hours = F.greatest(F.lit(0), F.unix_micros(reference) - F.unix_micros(event_at)) / 3.6e9
    return F.pow(F.lit(0.5), age_hours / config.HALF_LIFE_HOURS)


def mood_from_votes(vote_rows: DataFrame, as_of) -> DataFrame:
    """One row per (asset, day): score, confidence, counts, agreement.

    A vote weighs strength/3 x recency / (votes of its source that day). The last factor is the
    same for all votes of a source, so votes are summed per source first and divided then: two
    partial aggregations, and no window over a busy asset or source.
    """
    reference = F.least(numbers.instant(as_of), F.date_add("day", 1).cast("timestamp"))
    weight = F.col("strength") / config.MAX_STRENGTH * recency_weight(F.col("event_at"), reference)
    per_source = vote_rows.groupBy("asset_id", "day", "source_id").agg(
        F.count("*").alias("n"),
        F.sum(weight).alias("w"),
        F.sum(weight * F.col("direction")).alias("wv"),
        F.count_if(F.col("direction") > 0).alias("up"),
        F.count_if(F.col("direction") < 0).alias("down"),
    )
    # An article has one source, one story and one time, so each vote is another article.
    totals = per_source.groupBy("asset_id", "day").agg(
        F.sum(F.col("w") / F.col("n")).alias("w"),
        F.sum(F.col("wv") / F.col("n")).alias("wv"),
        F.sum("n").alias("article_count"),
        F.count("*").alias("source_count"),
        F.sum("up").alias("up"),
        F.sum("down").alias("down"),
    )
    score = F.when(F.col("w") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("wv") / F.col("w")))).otherwise(0.0)
    flat = F.col("article_count") - F.col("up") - F.col("down")
    agreeing = (
        F.when(numbers.sign(F.col("exact_score")) > 0, F.col("up"))
        .when(numbers.sign(F.col("exact_score")) < 0, F.col("down"))
        .otherwise(flat)
    )
    return (
        totals.withColumn("exact_score", score)
        .withColumn("exact_agreement", agreeing / F.col("article_count"))
        .select(
            "asset_id",
            "day",
            numbers.round3(F.col("exact_score")).alias("score"),
            numbers.confidence(F.col("source_count"), F.col("exact_agreement")).alias("confidence"),
            "article_count",
            "source_count",
            numbers.round3(F.col("exact_agreement")).alias("agreement"),
        )
    )


def daily_mood(signals: DataFrame, as_of) -> DataFrame:
    """Mood of every (asset, UTC day) with at least one vote.

    `signals`: asset_id, article_id, source_id, story_id, stance, strength, status, event_at,
    created_at.
    """
    return mood_from_votes(votes(usable_signals(signals)), as_of)


def with_article_times(signals: DataFrame, articles: DataFrame) -> DataFrame:
    """Signals joined to what the mood needs from their article."""
    return signals.join(
        articles.select("article_id", "source_id", "story_id", numbers.event_time().alias("event_at")), "article_id"
    )


def rolling_mood(signals: DataFrame, as_of, days: int = config.MOOD_DAYS) -> DataFrame:
    """Mood of the last `days` days, from signals created up to a week before them.

    Days whose votes all vanish are not part of the result, so an upsert keeps their stored row.
    """
    now = numbers.instant(as_of)
    since = numbers.days_before(now, days + config.MOOD_READ_MARGIN_DAYS)
    last_day = F.to_date(now)
    # The day limits reach the scan before the votes are counted.
    recent = signals.where((F.col("created_at") >= since) & F.to_date("event_at").between(F.date_sub(last_day, days - 1), last_day))
    return daily_mood(recent, as_of)
