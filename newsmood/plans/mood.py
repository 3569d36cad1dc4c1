"""Queries on mood, prices and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmood.functions import numbers
from newsmood.operators import mood, series
from newsmood.plans.registry import query
from newsmood.plans.views import AS_OF, text_of
from newsmood.sources import sinks

AS_OF_SQL = "TIMESTAMP '2024-01-31'"


@query("G1", "SELECT asset_id, article_id, stance, CAST(CASE WHEN stance IN ('bullish','hawkish') THEN 1 WHEN stance = 'neutral' "
       "THEN 0 ELSE -1 END AS BIGINT) AS direction FROM signals WHERE status = 'ok' AND stance <> 'unclear'", "signals")
def usable_signals(v):
    return mood.usable_signals(v.signals).select("asset_id", "article_id", "stance", F.col("direction").cast("long"))


@query("G2", "SELECT asset_id, CAST(day AS VARCHAR) AS day, source_id, story_key, article_id FROM votes", "votes")
def one_vote_per_story(v):
    return mood.votes(mood.usable_signals(v.signals)).select(
        "asset_id", text_of("day").alias("day"), "source_id", "story_key", "article_id"
    )


@query("G3 G4", f"""SELECT article_id, asset_id, round(pow(0.5, greatest(0, epoch_us(least({AS_OF_SQL},
  CAST(day + 1 AS TIMESTAMP))) - epoch_us(event_at)) / 86400e6), 9) AS recency,
  round(1 / count(*) OVER (PARTITION BY asset_id, day, source_id), 9) AS source_weight FROM votes""", "votes")
def vote_weights(v):
    votes = mood.votes(mood.usable_signals(v.signals))
    per_source = votes.groupBy("asset_id", "day", "source_id").agg((1 / F.count("*")).alias("source_weight"))
    reference = F.least(numbers.instant(AS_OF), F.date_add("day", 1).cast("timestamp"))
    return votes.join(per_source, ["asset_id", "day", "source_id"]).select(
        "article_id", "asset_id", F.round(mood.recency_weight(F.col("event_at"), reference), 9).alias("recency"),
        F.round("source_weight", 9).alias("source_weight"),
    )


@query("G5 G6 G7", "SELECT asset_id, CAST(day AS VARCHAR) AS day, score, confidence, CAST(article_count AS BIGINT) AS article_count, "
       "CAST(source_count AS BIGINT) AS source_count, agreement FROM mood", "mood")
def daily_mood(v):
    return mood.daily_mood(v.signals, AS_OF).withColumn("day", text_of("day"))


@query("G8", "SELECT asset_id, CAST(day AS VARCHAR) AS day, score, confidence, CAST(article_count AS BIGINT) AS article_count, "
       "CAST(source_count AS BIGINT) AS source_count, agreement FROM mood WHERE day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31'", "mood")
def rolling_mood(v):
    return mood.rolling_mood(v.signals, AS_OF).withColumn("day", text_of("day"))


@query("G9", """SELECT asset_id, CAST(day AS VARCHAR) AS day, CASE WHEN score >= 0.5 THEN 'mostly ' || up WHEN score >= 0.15 THEN 'leaning ' || up
  WHEN score > -0.15 THEN 'mixed' WHEN score > -0.5 THEN 'leaning ' || down ELSE 'mostly ' || down END AS word
  FROM (SELECT m.*, CASE WHEN asset_type = 'central_bank' THEN 'hawkish' ELSE 'bullish' END AS up,
  CASE WHEN asset_type = 'central_bank' THEN 'dovish' ELSE 'bearish' END AS down FROM mood m JOIN assets USING (asset_id))""", "mood assets")
def mood_words(v):
    return mood.daily_mood(v.signals, AS_OF).join(v.assets, "asset_id").select(
        "asset_id", text_of("day").alias("day"), numbers.mood_word(F.col("score"), F.col("asset_type")).alias("word")
    )


@query("A6", """SELECT asset_id, CAST(day AS VARCHAR) AS day, score, origin FROM (
  SELECT asset_id, day, score, 'batch' AS origin FROM mood WHERE day >= DATE '2024-01-25'
  UNION ALL SELECT asset_id, day, -9.0, 'stored' FROM mood WHERE day < DATE '2024-01-25')""", "mood")
def upsert_sink(v):
    """Mood of all days stored with a placeholder score, then the last week upserted over it."""
    batch = mood.rolling_mood(v.signals, AS_OF).select("asset_id", "day", "score", F.lit("batch").alias("origin"))
    stored = mood.daily_mood(v.signals, AS_OF).select(
        "asset_id", "day", F.lit(-9.0).alias("score"), F.lit("stored").alias("origin")
    )
    return sinks.upsert(batch, stored, ["asset_id", "day"], ["score"]).withColumn("day", text_of("day"))


# ---- prices and series ---------------------------------------------------------------------


@query("H1", "SELECT symbol, CAST(epoch AS BIGINT) AS epoch, open, high, low, close FROM candles", "candles")
def valid_candles(v):
    return series.valid_candles(v.raw_candles).withColumn("epoch", F.col("epoch").cast("long"))


@query("H2", """SELECT symbol, CAST(CAST(to_timestamp(epoch) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) AS candles
  FROM candles GROUP BY 1, 2""", "candles")
def candle_days(v):
    return (
        series.valid_candles(v.raw_candles)
        .groupBy("symbol", text_of(series.candle_day(F.col("epoch"))).alias("day"))
        .agg(F.count("*").alias("candles"))
    )


@query("H3", """SELECT asset_id, CAST(day AS VARCHAR) AS day, open, high, low, close, symbol FROM (
  SELECT *, 'a' || lpad(CAST(CAST(substr(symbol, 4) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS asset_id,
         row_number() OVER (PARTITION BY symbol, day ORDER BY epoch DESC, close DESC, open DESC, high DESC, low DESC) AS place
  FROM (SELECT *, CAST(to_timestamp(epoch) AT TIME ZONE 'UTC' AS DATE) AS day FROM candles)
  WHERE CAST(substr(symbol, 4) AS INTEGER) < 10) WHERE place = 1""", "candles")
def price_rows(v):
    rows = series.price_rows(series.valid_candles(v.raw_candles), v.symbols, "feed", AS_OF)
    return rows.select("asset_id", text_of("day").alias("day"), "open", "high", "low", "close", "symbol")


@query("H3", """SELECT s.symbol, coalesce(u.n, 0) AS usable, coalesce(r.n, 0) - coalesce(u.n, 0) AS dropped,
  CASE WHEN u.n IS NULL THEN 'no_candles' END AS error
  FROM (SELECT 'SYM' || n AS symbol FROM range(0, 10) t(n)) s LEFT JOIN (SELECT symbol, count(*) n FROM raw_candles GROUP BY 1) r USING (symbol)
  LEFT JOIN (SELECT symbol, count(*) n FROM candles GROUP BY 1) u USING (symbol)""", "candles raw_candles")
def symbol_results(v):
    return series.symbol_results(v.raw_candles, v.symbols)


@query("H4", """SELECT asset_id, CAST(max(day) AS VARCHAR) AS last_day FROM assets LEFT JOIN prices USING (asset_id) GROUP BY 1""", "prices assets")
def latest_price_days(v):
    return series.latest_days(v.assets.select("asset_id"), v.prices).withColumn("last_day", text_of("last_day"))


@query("H5", """SELECT asset_id, CAST(last_day AS VARCHAR) AS last_day FROM (
  SELECT asset_id, max(day) AS last_day FROM part_assets p LEFT JOIN prices USING (asset_id) GROUP BY 1
  UNION ALL SELECT asset_id, max(day) FROM prices GROUP BY 1)
  WHERE last_day IS NULL OR last_day < DATE '2024-01-31' ORDER BY last_day NULLS FIRST, asset_id LIMIT 2005""", "prices part_assets")
def pick_stale(v):
    """Assets with prices and never-priced ones, most out of date first (a top-n report)."""
    tracked = v.part_records.select("asset_id").unionByName(v.assets.select("asset_id"))
    dated = series.latest_days(tracked, v.prices).withColumn("slug", F.col("asset_id"))
    return series.pick_stale(dated, AS_OF, 2005).select("asset_id", text_of("last_day").alias("last_day"))


_SPINE = "SELECT asset_id, CAST(d AS DATE) AS day FROM assets, range(DATE '{first}', DATE '2024-02-01', INTERVAL 1 DAY) t(d)"


@query("H6", "SELECT asset_id, CAST(day AS VARCHAR) AS day FROM (SELECT asset_id, CAST(d AS DATE) AS day FROM part_assets, "
       "range(DATE '2024-01-25', DATE '2024-02-01', INTERVAL 1 DAY) t(d))", "part_assets")
def day_spine(v):
    return series.day_spine(v.part_records, AS_OF, 7).withColumn("day", text_of("day"))


@query("H7", f"""SELECT asset_id, CAST(day AS VARCHAR) AS day, score, confidence, coalesce(source_count, 0) AS source_count,
  CAST(coalesce(article_count, 0) AS BIGINT) AS article_count FROM ({_SPINE.format(first='2024-01-25')}) LEFT JOIN mood USING (asset_id, day)""",
       "mood assets")
def dense_mood(v):
    return series.dense_mood(v.assets, mood.daily_mood(v.signals, AS_OF), AS_OF).withColumn("day", text_of("day"))


@query("H8", "SELECT asset_id, CAST(day AS VARCHAR) AS day, close FROM prices WHERE day >= DATE '2023-11-02'", "prices")
def price_series(v):
    return series.price_series(v.prices, AS_OF).withColumn("day", text_of("day"))


@query("H9", """SELECT asset_id, article_id, CAST(CAST(event_at AS DATE) AS VARCHAR) AS day, stance, CAST(strength AS BIGINT) AS strength
  FROM signals WHERE status = 'ok' AND fetched_at >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, article_id) <= 500""", "signals")
def signal_timeline(v):
    return series.signal_timeline(v.signals, AS_OF, per_asset=500).select(
        "asset_id", "article_id", text_of("day").alias("day"), "stance", F.col("strength").cast("long")
    )


_CHART = f"""chart AS (SELECT asset_id, day, close, score AS mood, confidence, coalesce(n, 0) AS signals, coalesce(sign(s), 0) AS net
  FROM ({_SPINE.format(first='2023-11-03')}) LEFT JOIN prices USING (asset_id, day) LEFT JOIN mood USING (asset_id, day)
  LEFT JOIN (SELECT asset_id, CAST(event_at AS DATE) AS day, count(*) AS n,
    sum(CASE WHEN stance IN ('bullish','hawkish') THEN 1 WHEN stance IN ('bearish','dovish') THEN -1 ELSE 0 END) AS s
    FROM signals WHERE status = 'ok' GROUP BY 1, 2) USING (asset_id, day))"""


def _chart(v):
    return series.chart_rows(
        v.assets, series.price_series(v.prices, AS_OF), mood.daily_mood(v.signals, AS_OF),
        series.signal_timeline(v.signals, AS_OF, per_asset=None), AS_OF,
    )


@query("H10", "SELECT asset_id, CAST(day AS VARCHAR) AS day, close, mood, confidence, signals, CAST(net AS BIGINT) AS net FROM chart",
       "prices mood assets signals", recursive=_CHART)
def chart_rows(v):
    return _chart(v).withColumns({"day": text_of("day"), "net": F.col("net").cast("long")})


@query("H11", """SELECT asset_id, round(CASE WHEN count(close) >= 2 THEN (arg_max(close, day) / arg_min(close, day) - 1) * 100 END, 6) AS change_pct
  FROM chart GROUP BY asset_id""", "prices mood assets signals", recursive=_CHART)
def price_change(v):
    return series.price_change(_chart(v)).withColumn("change_pct", F.round("change_pct", 6))


@query("H12", """SELECT s.asset_id, CAST(CAST(event_at AS DATE) AS VARCHAR) AS day, article_id FROM signals s JOIN chart c
  ON c.asset_id = s.asset_id AND c.day = CAST(s.event_at AS DATE) WHERE s.status = 'ok' AND c.signals > 0 AND c.day >= DATE '2024-01-02'""",
       "prices mood assets signals", recursive=_CHART)
def news_day_signals(v):
    days = series.news_days(_chart(v), AS_OF, 30)
    timeline = series.signal_timeline(v.signals, AS_OF, per_asset=None)
    return series.signals_on_news_days(timeline, days).select("asset_id", text_of("day").alias("day"), "article_id")
