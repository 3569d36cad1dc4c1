"""State of the news sources after fetching them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").select(
        "source_id", "name", "feed_url", "etag", "last_modified", "consecutive_failures"
    )


def fold_outcomes(sources: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """The sources table after one run with one outcome per fetched source.

    `outcomes`: source_id, outcome (error, not_modified, ok), status text, etag, last_modified.
    An error adds a failure and switches the source off at the fifth in a row; anything else
    clears the failures; only a full answer replaces etag and last_modified, even with NULL.
    """
    fetched = outcomes.select(
        "source_id", "outcome", F.col("status").alias("new_status"), F.col("etag").alias("new_etag"),
        F.col("last_modified").alias("new_modified"),
    )
    failures = F.when(F.col("outcome") == "error", F.col("consecutive_failures") + 1).when(
        F.col("outcome").isNotNull(), 0
    ).otherwise(F.col("consecutive_failures"))
    off = (F.col("outcome") == "error") & (F.col("consecutive_failures") + 1 >= config.MAX_CONSECUTIVE_FAILURES)
    seen = F.col("outcome").isNotNull()
    full = F.col("outcome") == "ok"
    replaced = {
        "is_active": F.when(off, False).otherwise(F.col("is_active")),
        "etag": F.when(full, F.col("new_etag")).otherwise(F.col("etag")),
        "last_modified": F.when(full, F.col("new_modified")).otherwise(F.col("last_modified")),
        "last_fetched_at": F.when(seen, numbers.instant(as_of)).otherwise(F.col("last_fetched_at")),
        "last_status": F.when(seen, F.col("new_status")).otherwise(F.col("last_status")),
        "consecutive_failures": failures,
    }
    return sources.join(fetched, "source_id", "left").select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in sources.columns]
    )


def outcome_counts(sources_before: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of run counters: sources, ok, not modified, failed, switched off."""
    error = F.col("outcome") == "error"
    off = error & (F.col("consecutive_failures") + 1 >= config.MAX_CONSECUTIVE_FAILURES)
    return sources_before.where("is_active").join(outcomes.select("source_id", "outcome"), "source_id", "left").agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("outcome") == "ok").alias("fetched_ok"),
        F.count_if(F.col("outcome") == "not_modified").alias("not_modified"),
        F.count_if(error).alias("failed"),
        F.count_if(off).alias("deactivated"),
    )


def failure_streaks(history: DataFrame) -> DataFrame:
    """Failures in a row at the end of each source's fetch history, and whether that is too many.

    `history`: source_id, fetched_at, fetch_id, outcome. The last success of each source is found
    by a partial aggregation and the failures after it are counted by another one; no source's
    history is sorted in one task.
    """
    moment = F.struct("fetched_at", "fetch_id")
    last_success = history.where("outcome <> 'error'").groupBy("source_id").agg(F.max(moment).alias("last_success"))
    return (
        history.join(last_success, "source_id", "left")
        .groupBy("source_id")
        .agg(
            F.count("*").alias("fetches"),
            F.count_if(
                (F.col("outcome") == "error") & (F.col("last_success").isNull() | (moment > F.col("last_success")))
            ).alias("consecutive_failures"),
        )
        .withColumn("deactivate", F.col("consecutive_failures") >= config.MAX_CONSECUTIVE_FAILURES)
    )


def feed_freshness(items: DataFrame, as_of, days: int = config.MAX_AGE_DAYS) -> DataFrame:
    """Per feed: items, items of the last week, newest date; accepted with at least one recent."""
    since = numbers.days_before(numbers.instant(as_of), days)
    return (
        items.groupBy("feed")
        .agg(
            F.count("*").alias("items"),
            F.count_if(F.col("item_at") > since).alias("recent"),
            F.max("item_at").alias("newest"),
        )
        .withColumn("accepted", F.col("recent") > 0)
    )
