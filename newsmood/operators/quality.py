"""Data-quality jobs from the declared constraints of the tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood import config


# The check constraints of every table, as (rule, predicate).
CHECKS: dict[str, dict[str, Column | str]] = {
    "sources": {
        "feed_url_https": "feed_url LIKE 'https://%'",
        "kind": "kind IN ('central_bank', 'news', 'markets')",
    },
    "assets": {
        "slug_format": f"slug RLIKE '{config.SLUG_PATTERN}'",
        "asset_type": "asset_type IN ('currency_pair', 'commodity', 'index', 'stock', 'crypto', 'central_bank')",
    },
    "asset_aliases": {"alias_length": "length(alias) BETWEEN 1 AND 60"},
    "articles": {
        "url_http": "url RLIKE '^https?://'",
        "title_length": "length(title) <= 500",
        "excerpt_length": "length(excerpt) <= 500",
    },
    "asset_mentions": {"sentences_size": "size(sentences) BETWEEN 1 AND 6"},
    "asset_signals": {
        "stance": "stance IN ('bullish', 'bearish', 'hawkish', 'dovish', 'neutral', 'unclear')",
        "strength": "strength BETWEEN 0 AND 3",
        "why_length": "length(why) <= 200",
        "status": "status IN ('ok', 'unclear', 'failed')",
        "failure_reason": "failure_reason IS NULL OR (status = 'failed' AND failure_reason IN "
        "('invalid_json', 'bad_citation', 'schema'))",
    },
    "daily_mood": {
        "score_range": "score BETWEEN -1 AND 1",
        "confidence": "confidence IN ('low', 'medium', 'high')",
    },
    "daily_prices": {"high_low_close": "high >= low AND close > 0"},
    "briefs": {"level": "level IN ('standard', 'beginner')", "source": "source IN ('ai', 'template')"},
    "llm_calls": {
        "stage": "stage IN ('stance', 'brief')",
        "status": "status IN ('ok', 'schema_retry', 'failed', 'timeout', 'rate_limited')",
    },
    "job_runs": {
        "job": "job IN ('ingest', 'score', 'mood', 'prices')",
        "status": "status IN ('ok', 'partial', 'failed')",
    },
}

# Primary and unique keys.
KEYS: dict[str, list[list[str]]] = {
    "sources": [["source_id"], ["feed_url"]],
    "assets": [["asset_id"], ["slug"]],
    "asset_aliases": [["asset_id", "alias"]],
    "stories": [["story_id"]],
    "articles": [["article_id"], ["url"], ["url_hash"]],
    "asset_mentions": [["article_id", "asset_id"]],
    "asset_signals": [["article_id", "asset_id"]],
    "daily_mood": [["asset_id", "day"]],
    "daily_prices": [["asset_id", "day"]],
    "watchlists": [["user_id", "asset_id"]],
    "user_settings": [["user_id"]],
    "briefs": [["user_id", "day", "level", "watchlist_hash"]],
}


def _predicate(rule: Column | str) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def check_counts(table: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """Violations per rule, all rules in one pass: rule, violations. NULL passes, as in SQL."""
    counted = table.agg(*[F.count_if(~_predicate(p)).alias(name) for name, p in rules.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.inline(entries))


def check_violations(table: DataFrame, rules: Mapping[str, Column | str]) -> DataFrame:
    """The violating rows, one per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~_predicate(p), F.lit(n)) for n, p in rules.items()]))
    return table.withColumn("rule", F.explode(broken))


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values stored more than once; NULL keys are not compared."""
    complete = table
    for key in keys:
        complete = complete.where(F.col(key).isNotNull())
    return complete.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows of `child` whose reference (child column -> parent column) has no parent."""
    referenced = parent.select(*[F.col(p).alias(c) for c, p in keys.items()]).distinct()
    complete = child
    for key in keys:
        complete = complete.where(F.col(key).isNotNull())
    return complete.join(referenced, list(keys), "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`child` after its parents with these keys were deleted."""
    return child.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """`child` with its reference emptied where the parent was deleted."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    return child.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*child.columns)


def catalogue_problems(assets: DataFrame, aliases: DataFrame, sources: DataFrame) -> DataFrame:
    """What makes a catalogue unusable: (problem, subject)."""
    per_asset = aliases.groupBy("asset_id").agg(F.count("*").alias("n"))
    few = assets.join(per_asset, "asset_id", "left").where(F.coalesce("n", F.lit(0)) < 2)
    found = lambda df, problem, subject: df.select(F.lit(problem).alias("problem"), F.col(subject).alias("subject"))
    return (
        found(assets.where(~F.col("slug").rlike(config.SLUG_PATTERN)), "slug_format", "slug")
        .unionByName(found(few, "few_aliases", "slug"))
        .unionByName(found(duplicate_keys(assets, ["slug"]), "duplicate_slug", "slug"))
        .unionByName(found(sources.where(~F.col("feed_url").startswith("https://")), "feed_not_https", "feed_url"))
    )
