"""Prices and daily series: candles, dense mood, timelines, chart rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text
from newsmood.operators.dedupe import first_per_key

_FIELDS = ["epoch", "open", "high", "low", "close"]


def valid_candles(raw: DataFrame) -> DataFrame:
    """Candles whose five fields are finite numbers with close > 0 and high >= low.

    Fields may be numbers or numeric text (blank text counts as 0); all others are dropped.
    """

    def number(t: Column) -> Column:
        # The cast also takes Java's type suffixes, which are no part of a number here.
        suffixed = F.lower(F.right(t, F.lit(1))).isin("d", "f")
        return F.when(t == "", 0.0).when(~suffixed, t.try_cast("double"))

    fields = F.struct(*[text.let(F.trim(F.col(name).cast("string")), number).alias(name) for name in _FIELDS])

    def usable(c: Column) -> Column:
        finite = F.lit(True)
        for name in _FIELDS:
            finite = finite & F.coalesce(F.abs(c[name]) < float("inf"), F.lit(False))
        return finite & (c["close"] > 0) & (c["high"] >= c["low"])

    # One struct per row, kept or dropped as a whole: each field is parsed once.
    others = [c for c in raw.columns if c not in _FIELDS]
    return raw.select(*others, F.inline(F.filter(F.array(fields), usable)))


def candle_day(epoch: Column) -> Column:
    """UTC calendar day of an epoch in seconds."""
    return F.to_date(F.timestamp_seconds(epoch))


def price_rows(candles: DataFrame, symbols: DataFrame, source: str, as_of) -> DataFrame:
    """Valid candles as daily price rows of the mapped asset; the latest epoch of a day wins."""
    dated = candles.withColumn("day", candle_day(F.col("epoch")))
    latest = first_per_key(dated, ["symbol", "day"], [F.desc(c) for c in ("epoch", "close", "open", "high", "low")])
    return latest.join(symbols.select("symbol", "asset_id"), "symbol").select(
        "asset_id", "day", "open", "high", "low", "close", F.lit(source).alias("source"), "symbol",
        numbers.instant(as_of).alias("fetched_at"),
    )


def symbol_results(raw: DataFrame, tracked: DataFrame) -> DataFrame:
    """Per tracked symbol: usable and dropped candles, and an error code where none is usable."""
    received = raw.groupBy("symbol").agg(F.count("*").alias("received"))
    usable = valid_candles(raw).groupBy("symbol").agg(F.count("*").alias("usable"))
    zero = F.lit(0).cast("long")
    return (
        tracked.select("symbol").join(received, "symbol", "left").join(usable, "symbol", "left")
        .select(
            "symbol",
            F.coalesce("usable", zero).alias("usable"),
            (F.coalesce("received", zero) - F.coalesce("usable", zero)).alias("dropped"),
            F.when(F.coalesce("usable", zero) == 0, "no_candles").alias("error"),
        )
    )


def latest_days(tracked: DataFrame, prices: DataFrame) -> DataFrame:
    """Last stored day of every tracked asset, NULL where nothing is stored."""
    last = prices.groupBy("asset_id").agg(F.max("day").alias("last_day"))
    return tracked.join(last, "asset_id", "left")


def pick_stale(tracked: DataFrame, as_of, n: int) -> DataFrame:
    """The `n` most out-of-date symbols: never fetched first, then the oldest, then by slug."""
    today = F.to_date(numbers.instant(as_of))
    return (
        tracked.where(F.col("last_day").isNull() | (F.col("last_day") < today))
        .orderBy(F.asc_nulls_first("last_day"), "slug")
        .limit(n)
    )


def day_spine(assets: DataFrame, as_of, days: int) -> DataFrame:
    """One row per asset and UTC day, the last `days` days up to as_of."""
    last = F.to_date(numbers.instant(as_of))
    return assets.select("asset_id", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def dense_mood(assets: DataFrame, mood: DataFrame, as_of, days: int = config.MOOD_DAYS) -> DataFrame:
    """Mood of each asset on each of the last days; NULL score and zero counts where none is."""
    first = F.date_sub(F.to_date(numbers.instant(as_of)), days - 1)
    stored = mood.where(F.col("day") >= first).select(
        "asset_id", "day", "score", "confidence", "source_count", "article_count"
    )
    return day_spine(assets, as_of, days).join(stored, ["asset_id", "day"], "left").select(
        "asset_id", "day", "score", "confidence",
        F.coalesce("source_count", F.lit(0).cast("long")).alias("source_count"),
        F.coalesce("article_count", F.lit(0).cast("long")).alias("article_count"),
    )


def price_series(prices: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Closes of the last `days` days."""
    since = F.date_sub(F.to_date(numbers.instant(as_of)), days)
    return prices.where(F.col("day") >= since).select("asset_id", "day", "close")


def signal_timeline(signals: DataFrame, as_of, per_asset: int | None, days: int = 90) -> DataFrame:
    """Scored signals by arrival window, newest created first, at most `per_asset` each.

    `signals` carry fetched_at and event_at of their article. The limit is a group limit that
    every map task applies before the shuffle.
    """
    since = numbers.days_before(numbers.instant(as_of), days)
    recent = signals.where((F.col("status") == "ok") & (F.col("fetched_at") >= since)).withColumn(
        "day", F.to_date("event_at")
    )
    if per_asset is None:
        return recent
    newest = F.row_number().over(
        Window.partitionBy("asset_id").orderBy(F.desc("created_at"), F.asc("article_id"))
    )
    return recent.withColumn("_newest", newest).where(F.col("_newest") <= per_asset).drop("_newest")


def chart_rows(
    assets: DataFrame, prices: DataFrame, mood: DataFrame, timeline: DataFrame, as_of, days: int = 90
) -> DataFrame:
    """One row per asset and day: close, mood, confidence, signals and their net direction."""
    keys = ["asset_id", "day"]
    direction = F.coalesce(numbers.stance_value(F.col("stance")), F.lit(0))
    daily = timeline.groupBy(*keys).agg(
        F.count("*").alias("signals"), F.signum(F.sum(direction)).cast("int").alias("net")
    )
    return (
        day_spine(assets, as_of, days)
        .join(prices.select(*keys, "close"), keys, "left")
        .join(mood.select(*keys, F.col("score").alias("mood"), "confidence"), keys, "left")
        .join(daily, keys, "left")
        .select(
            *keys, "close", "mood", "confidence",
            F.coalesce("signals", F.lit(0).cast("long")).alias("signals"),
            F.coalesce("net", F.lit(0)).alias("net"),
        )
    )


def price_change(rows: DataFrame) -> DataFrame:
    """Change in percent from the first to the last known close; NULL below two closes."""
    known = rows.where("close IS NOT NULL").groupBy("asset_id").agg(
        F.count("*").alias("closes"), F.min_by("close", "day").alias("first"), F.max_by("close", "day").alias("last")
    )
    change = F.when(F.col("closes") >= 2, (F.col("last") / F.col("first") - 1) * 100)
    return rows.select("asset_id").distinct().join(known, "asset_id", "left").select(
        "asset_id", change.alias("change_pct")
    )


def news_days(rows: DataFrame, as_of, last_days: int) -> DataFrame:
    """Days of the visible range with at least one signal."""
    first = F.date_sub(F.to_date(numbers.instant(as_of)), last_days - 1)
    return rows.where((F.col("day") >= first) & (F.col("signals") > 0)).select("asset_id", "day", "signals")


def signals_on_news_days(timeline: DataFrame, days: DataFrame) -> DataFrame:
    return timeline.join(days, ["asset_id", "day"], "left_semi")
