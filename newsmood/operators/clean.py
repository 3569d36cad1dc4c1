"""Feed items to clean articles, with a reason for every rejected item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text, urls


def normalise_items(items: DataFrame, as_of) -> DataFrame:
    """Clean raw items; one pass, no shuffle.

    `items` has title, link, summary, date (all strings, nullable); other columns pass through.
    Adds url, url_hash, body, excerpt, published_at and reject_reason, and replaces title. Title and body are whole; excerpt
    is the body shortened for display, and nothing is computed from it. The first failing rule decides the reason: no_title, bad_url, too_old. A future date is clamped to
    `as_of`; an item without a readable date is accepted with a NULL time.
    """
    now = numbers.instant(as_of)
    cleaned = items.select(
        *[c for c in items.columns if c not in ("title", "link", "summary", "date")],
        text.strip_html(F.coalesce("title", F.lit(""))).alias("title"),
        urls.canonical_url(F.col("link")).alias("url"),
        text.strip_html(F.coalesce("summary", F.lit(""))).alias("body"),
        numbers.published_at(F.col("date"), now).alias("published_at"),
    )
    too_old = F.col("published_at") < numbers.days_before(now, config.MAX_AGE_DAYS)
    return cleaned.withColumns(
        {
            "url_hash": urls.url_hash(F.col("url")),
            "excerpt": text.truncate(F.col("body"), config.EXCERPT_MAX),
            "reject_reason": F.when(F.col("title") == "", "no_title")
            .when(F.col("url").isNull(), "bad_url")
            .when(too_old, "too_old"),
        }
    )


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.where(F.col("reject_reason").isNull()).drop("reject_reason")


def skip_reasons(normalised: DataFrame) -> DataFrame:
    """How many items each rule rejected."""
    return (
        normalised.where(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("items"))
    )
