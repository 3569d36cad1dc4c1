"""Queries on read models and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.operators import quality, reads
from newsmood.plans.oracle_views import EVENT_TIME
from newsmood.plans.registry import query
from newsmood.plans.views import AS_OF, stamp
from newsmood.sources import catalogue

_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
SOURCE = "coalesce(s.name, 'Unknown source') AS source"


@query("I1", "SELECT asset_id, slug, name, asset_type FROM part_assets ORDER BY asset_type, name, asset_id", "part_assets")
def ordered_catalogue(v):
    return catalogue.ordered_catalogue(catalogue.asset_rows(v.part_records)).select("asset_id", "slug", "name", "asset_type")


@query("I1", "SELECT asset_id, slug, name, asset_type FROM part_assets WHERE slug = 'small-ring-0'", "part_assets")
def asset_by_slug(v):
    return catalogue.asset_by_slug(catalogue.asset_rows(v.part_records), "small-ring-0").select("asset_id", "slug", "name", "asset_type")


@query("I2", """SELECT asset_id, asset_type FROM part_assets WHERE contains(lower(name || ' ' || slug || ' ' || description_simple || ' ' ||
  CASE asset_type WHEN 'currency_pair' THEN 'Currencies' WHEN 'commodity' THEN 'Commodities' WHEN 'index' THEN 'Stock indices'
    WHEN 'stock' THEN 'Stocks' WHEN 'crypto' THEN 'Crypto' ELSE 'Central banks' END), 'ban')""", "part_assets")
def catalogue_search(v):
    return catalogue.search_catalogue(catalogue.asset_rows(v.part_records), " BAN ").select("asset_id", "asset_type")


@query("I2", """SELECT asset_type, count(*) AS assets FROM part_assets WHERE contains(lower(name || ' ' || slug || ' ' || description_simple || ' ' ||
  CASE asset_type WHEN 'currency_pair' THEN 'Currencies' WHEN 'commodity' THEN 'Commodities' WHEN 'index' THEN 'Stock indices'
    WHEN 'stock' THEN 'Stocks' WHEN 'crypto' THEN 'Crypto' ELSE 'Central banks' END), 'red') GROUP BY 1""", "part_assets")
def catalogue_search_groups(v):
    return catalogue.search_group_counts(catalogue.search_catalogue(catalogue.asset_rows(v.part_records), "red"))


_STORY_ROWS = f"""rows AS (SELECT m.asset_id, m.article_id, a.title, a.url, a.source_id, {EVENT_TIME} AS event_at,
    coalesce(a.story_id, 'article:' || a.article_id) AS story_key, t.headline AS th, t.article_count AS ta, t.source_count AS tsc
    FROM mentions m JOIN articles a USING (article_id) LEFT JOIN stories t USING (story_id) WHERE a.fetched_at >= TIMESTAMP '2024-01-29'),
  grp AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY source_count DESC, last_at DESC, story_key) AS story_rank FROM (
    SELECT asset_id, story_key, max(event_at) AS last_at, coalesce(max(tsc), 1) AS source_count, coalesce(max(ta), 1) AS article_count,
           coalesce(max(th), arg_min(title, article_id)) AS headline FROM rows GROUP BY 1, 2))"""


@query("I3", f"""SELECT r.asset_id, CAST(story_rank AS BIGINT) AS story_rank, g.story_key, headline, source_count, article_count, {_AT.format('last_at')} AS last_at,
  r.article_id, title, url, {SOURCE}, {_AT.format('event_at')} AS event_at, stance, CAST(strength AS BIGINT) AS strength, status
  FROM grp g JOIN rows r USING (asset_id, story_key) LEFT JOIN sources s USING (source_id)
  LEFT JOIN (SELECT asset_id, article_id, stance, strength, status FROM mention_signals) x USING (asset_id, article_id) WHERE story_rank <= 20""",
       "mentions articles stories sources mention_signals", recursive=_STORY_ROWS)
def asset_stories(v):
    rows = reads.asset_stories(v.mentions, v.articles, v.stories, v.mention_signals, v.sources, AS_OF, limit=20)
    return rows.select(
        "asset_id", F.col("story_rank").cast("long"), "story_key", "headline", "source_count", "article_count",
        stamp("last_at").alias("last_at"), "article_id", "title", "url", "source", stamp("event_at").alias("event_at"), "stance",
        F.col("strength").cast("long"), "status",
    )


_EVIDENCE = f"""SELECT asset_id, article_id, title, {SOURCE}, stance, CAST(strength AS BIGINT) AS strength, status, why, evidence_id, {_AT.format('x.event_at')} AS event_at,
  array_to_string(sids, ',') AS sids FROM (SELECT g.*, a.title, a.source_id, row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, article_id) AS place
    FROM mention_signals g JOIN articles a USING (article_id) WHERE a.fetched_at >= TIMESTAMP '2024-01-24') x
  LEFT JOIN sources s USING (source_id) LEFT JOIN mentions USING (asset_id, article_id)"""


def _with_evidence(v, per_asset):
    rows = reads.signals_with_evidence(v.mention_signals, v.mentions, v.articles, v.sources, AS_OF, per_asset=per_asset)
    return rows.select(
        "asset_id", "article_id", "title", "source", "stance", F.col("strength").cast("long"), "status", "why",
        F.get("evidence_ids", F.lit(0)).alias("evidence_id"), stamp("event_at").alias("event_at"),
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sids"),
    )


@query("I4", _EVIDENCE + " WHERE place <= 100", "mention_signals articles sources mentions")
def signals_with_evidence(v):
    return _with_evidence(v, 100)


@query("I4", _EVIDENCE, "mention_signals articles sources mentions")
def all_signals_with_evidence(v):
    return _with_evidence(v, None)


@query("I5", f"""SELECT article_id, asset_id, c.name, asset_type, title, {SOURCE}, stance, CAST(strength AS BIGINT) AS strength, array_to_string(sids, ',') AS sids
  FROM mention_signals g JOIN articles a USING (article_id) JOIN assets c USING (asset_id) LEFT JOIN sources s ON s.source_id = a.source_id
  LEFT JOIN mentions USING (article_id, asset_id) WHERE status = 'ok' AND stance IN ('bullish','bearish','hawkish','dovish') AND strength >= 2
  AND a.fetched_at >= TIMESTAMP '2024-01-29' ORDER BY created_at DESC, article_id, asset_id LIMIT 1""", "mention_signals articles assets sources mentions")
def latest_receipt(v):
    return reads.latest_receipt(v.mention_signals, v.mentions, v.articles, v.sources, v.assets, AS_OF).select(
        "article_id", "asset_id", "name", "asset_type", "title", "source", "stance", F.col("strength").cast("long"),
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sids"),
    )


@query("I6", f"""SELECT asset_id, coalesce(n, 0) AS signals, last_stance, {_AT.format('last_at')} AS last_at FROM assets LEFT JOIN (
  SELECT asset_id, CAST(count_if(fetched_at >= TIMESTAMP '2024-01-29') AS BIGINT) AS n,
    arg_max(stance, struct_pack(e := event_at, c := created_at, a := article_id)) FILTER (WHERE stance <> 'unclear') AS last_stance,
    max(event_at) FILTER (WHERE stance <> 'unclear') AS last_at
  FROM signals WHERE status <> 'failed' AND fetched_at >= TIMESTAMP '2024-01-24' GROUP BY 1) USING (asset_id)""", "assets signals")
def active_assets(v):
    return reads.active_assets(v.assets, v.signals, AS_OF).select("asset_id", "signals", "last_stance", stamp("last_at").alias("last_at"))


@query("I7", """SELECT 'sources' AS metric, count(*) AS value FROM sources WHERE is_active
  UNION ALL SELECT 'articles_24h', count(*) FROM articles WHERE fetched_at >= TIMESTAMP '2024-01-30'
  UNION ALL SELECT 'assets', count(*) FROM assets UNION ALL SELECT 'signals_24h', count(*) FROM signals WHERE created_at >= TIMESTAMP '2024-01-30'
  UNION ALL SELECT 'last_updated', CAST(epoch(max(last_fetched_at)) AS BIGINT) FROM sources""", "sources articles assets signals")
def site_stats(v):
    return reads.site_stats(v.sources, v.articles, v.assets, v.signals, AS_OF)


@query("I8", "SELECT count(*) > 0 AS has_signals FROM signals", "signals")
def any_signal(v):
    return reads.any_signal(v.signals)


@query("I9", """SELECT user_id, asset_id, name, row_number() OVER (PARTITION BY user_id ORDER BY added_at, asset_id) AS position
  FROM watchlists JOIN assets USING (asset_id)""", "watchlists assets")
def watchlists_in_order(v):
    return reads.watchlists_in_order(v.watchlists, v.assets).select("user_id", "asset_id", "name", F.col("position").cast("long"))


@query("I9", """SELECT DISTINCT w.user_id, coalesce(u.beginner_mode, false) AS beginner_mode FROM watchlists w
  LEFT JOIN users u USING (user_id)""", "watchlists users")
def beginner_flags(v):
    stored = v.users.select("user_id", "beginner_mode")
    return reads.beginner_flags(v.watchlists, stored)


@query("I10", """SELECT m.article_id, m.asset_id, a.slug, a.name, stance, CAST(strength AS BIGINT) AS strength, status, coalesce(why, '') AS why, array_to_string(sids, ',') AS sids
  FROM mentions m LEFT JOIN assets a USING (asset_id) LEFT JOIN mention_signals g ON g.article_id = m.article_id AND g.asset_id = m.asset_id
  WHERE a.slug IN ('a01', 'a05', 'a07')""", "mentions assets mention_signals")
def article_evidence(v):
    rows = reads.article_evidence(v.mentions, v.assets, v.mention_signals, slugs=["a01", "a05", "a07"])
    return rows.select(
        "article_id", "asset_id", "slug", "name", "stance", F.col("strength").cast("long"), "status", "why",
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sids"),
    )


@query("I11", """SELECT m.article_id, m.asset_id, CASE WHEN g.evidence_id IS NULL THEN '' ELSE texts[list_position(sids, g.evidence_id)] END AS cited,
  array_to_string(list_transform(sids, lambda s: s || CASE WHEN s = coalesce(g.evidence_id, '') THEN '*' ELSE '' END), ',') AS flags
  FROM mentions m LEFT JOIN mention_signals g ON g.article_id = m.article_id AND g.asset_id = m.asset_id""", "mentions mention_signals")
def cited_sentences(v):
    blocks = reads.cited_texts(reads.article_evidence(v.mentions, v.assets, v.mention_signals))
    return blocks.select(
        "article_id", "asset_id", F.array_join(F.transform("cited", lambda s: s["text"]), " / ").alias("cited"),
        F.array_join(F.transform("flagged", lambda s: F.concat(s["id"], F.when(s["cited"], "*").otherwise(""))), ",").alias("flags"),
    )


@query("I12", f"""SELECT asset_id, article_id, stance, CAST(strength AS BIGINT) AS strength, {_AT.format('event_at')} AS event_at FROM signals
  WHERE status <> 'failed' AND stance <> 'unclear' QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY signals.event_at DESC, created_at DESC, article_id DESC) = 1""", "signals")
def last_scored(v):
    return reads.last_scored(v.signals).select("asset_id", "article_id", "stance", F.col("strength").cast("long"), stamp("event_at").alias("event_at"))


@query("I13", "SELECT user_id, asset_id FROM watchlists WHERE user_id = 7", "watchlists")
def own_rows(v):
    return reads.readable("watchlists", v.watchlists, 7).select("user_id", "asset_id")


@query("I13", """SELECT 'articles' AS name, count(*) AS visible FROM articles UNION ALL SELECT 'watchlists', count(*) FROM watchlists WHERE user_id = 7
  UNION ALL SELECT 'llm_calls', 0""", "articles watchlists")
def visible_rows(v):
    """What one signed-in user can read of an open, a private and an operations table."""
    tables = {"articles": v.articles, "watchlists": v.watchlists, "llm_calls": v.calls}
    parts = [
        reads.readable(name, table, 7).agg(F.count("*").alias("visible")).select(F.lit(name).alias("name"), "visible")
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- data quality --------------------------------------------------------------------------


@query("K1", """SELECT 'articles' AS tab, 'url_http' AS rule, CAST(count_if(NOT regexp_matches(url, '^https?://')) AS BIGINT) AS violations FROM articles
  UNION ALL SELECT 'articles', 'title_length', CAST(count_if(length(title) > 500) AS BIGINT) FROM articles
  UNION ALL SELECT 'articles', 'excerpt_length', CAST(count_if(length(excerpt) > 500) AS BIGINT) FROM articles
  UNION ALL SELECT 'sources', 'feed_url_https', CAST(count_if(feed_url NOT LIKE 'https://%') AS BIGINT) FROM sources
  UNION ALL SELECT 'sources', 'kind', CAST(count_if(kind NOT IN ('central_bank','news','markets')) AS BIGINT) FROM sources
  UNION ALL SELECT 'assets', 'slug_format', CAST(count_if(NOT regexp_matches(slug, '^[a-z0-9-]{2,30}$')) AS BIGINT) FROM part_assets
  UNION ALL SELECT 'assets', 'asset_type', CAST(count_if(asset_type NOT IN ('currency_pair','commodity','index','stock','crypto','central_bank')) AS BIGINT) FROM part_assets
  UNION ALL SELECT 'asset_aliases', 'alias_length', CAST(count_if(length(alias) NOT BETWEEN 1 AND 60) AS BIGINT) FROM part_aliases
  UNION ALL SELECT 'asset_mentions', 'sentences_size', CAST(count_if(len(sids) NOT BETWEEN 1 AND 6) AS BIGINT) FROM mentions
  UNION ALL SELECT 'daily_prices', 'high_low_close', CAST(count_if(NOT (high >= low AND close > 0)) AS BIGINT) FROM (
    SELECT TRY_CAST(high AS DOUBLE) AS high, TRY_CAST(low AS DOUBLE) AS low, TRY_CAST(close AS DOUBLE) AS close FROM raw_candles)
  UNION ALL SELECT 'daily_mood', 'score_range', CAST(count_if(score NOT BETWEEN -1 AND 1) AS BIGINT) FROM mood
  UNION ALL SELECT 'daily_mood', 'confidence', CAST(count_if(confidence NOT IN ('low','medium','high')) AS BIGINT) FROM mood
  UNION ALL SELECT 'llm_calls', 'stage', CAST(count_if(stage NOT IN ('stance','brief')) AS BIGINT) FROM calls
  UNION ALL SELECT 'llm_calls', 'status', CAST(count_if(status NOT IN ('ok','schema_retry','failed','timeout','rate_limited')) AS BIGINT) FROM calls
  UNION ALL SELECT 'asset_signals', 'stance', CAST(count_if(stance NOT IN ('bullish','bearish','hawkish','dovish','neutral','unclear')) AS BIGINT) FROM signals
  UNION ALL SELECT 'asset_signals', 'strength', CAST(count_if(strength NOT BETWEEN 0 AND 3) AS BIGINT) FROM signals
  UNION ALL SELECT 'asset_signals', 'status', CAST(count_if(status NOT IN ('ok','unclear','failed')) AS BIGINT) FROM signals
  UNION ALL SELECT 'asset_signals', 'failure_reason', CAST(count_if(status <> 'failed' AND strength = 3) AS BIGINT) FROM signals
  UNION ALL SELECT 'asset_signals', 'why_length', CAST(count_if(article_id % 230 > 200) AS BIGINT) FROM signals
  UNION ALL SELECT 'briefs', 'level', CAST(count_if(o_orderpriority = '5-LOW') AS BIGINT) FROM orders
  UNION ALL SELECT 'briefs', 'source', CAST(count_if(o_orderstatus = 'P') AS BIGINT) FROM orders
  UNION ALL SELECT 'job_runs', 'job', CAST(count_if(l_linenumber % 5 = 4) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'job_runs', 'status', CAST(count_if(l_linenumber % 4 = 3) AS BIGINT) FROM lineitem""",
       "articles sources part_assets part_aliases mentions raw_candles mood calls signals")
def check_constraints(v):
    """Violations of all declared checks; some rows carry planted reasons, texts, levels and states that break a rule."""
    from newsmood.operators import mood

    candles = v.raw_candles.select(*[F.col(c).try_cast("double").alias(c) for c in ("high", "low", "close")])
    signals = v.signals.withColumns({
        "failure_reason": F.when(F.col("strength") == 3, "schema"), "why": F.repeat(F.lit("y"), (F.col("article_id") % 230).cast("int"))})
    briefs = v.table("orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "expert").otherwise("standard").alias("level"),
        F.when(F.col("o_orderstatus") == "P", "human").when(F.col("o_orderstatus") == "F", "ai").otherwise("template").alias("source"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    runs = v.table("lineitem").select(
        pick(["ingest", "score", "mood", "prices", "backup"], F.col("l_linenumber") % 5).alias("job"),
        pick(["ok", "partial", "failed", "running"], F.col("l_linenumber") % 4).alias("status"))
    tables = {
        "articles": v.articles, "sources": v.sources, "assets": v.part_records, "asset_mentions": v.mentions, "daily_prices": candles,
        "asset_aliases": catalogue.alias_rows(v.part_records, catalogue.asset_rows(v.part_records)),
        "daily_mood": mood.daily_mood(v.signals, AS_OF), "llm_calls": v.calls, "asset_signals": signals,
        "briefs": briefs, "job_runs": runs,
    }
    parts = [
        quality.check_counts(t, quality.CHECKS[name]).withColumn("tab", F.lit(name))
        for name, t in tables.items()
    ]
    assert set(tables) == set(quality.CHECKS)
    return reduce(DataFrame.unionByName, parts).select("tab", "rule", "violations")


@query("K1", """SELECT article_id, 'excerpt_length' AS rule FROM articles WHERE length(excerpt) > 500
  UNION ALL SELECT article_id, 'title_length' FROM articles WHERE length(title) > 500""", "articles")
def check_violations(v):
    return quality.check_violations(v.articles, quality.CHECKS["articles"]).select("article_id", "rule")


# Key columns of the mapped tables, and the SQL table that holds each of them.
_KEYED = {
    "sources": "sources", "assets": "part_assets", "asset_aliases": "part_aliases", "stories": "stories", "articles": "articles",
    "asset_mentions": "mentions", "asset_signals": "signals", "daily_mood": "mood", "daily_prices": "prices", "watchlists": "watchlists",
    "user_settings": "users",
    "briefs": "(SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, 'standard' AS level, 'h' || o_custkey AS watchlist_hash FROM orders)",
}
_DUPLICATES = " UNION ALL ".join(
    f"SELECT '{tab}' AS tab, '{','.join(key)}' AS key, count(*) AS values_repeated, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count FROM "
    f"(SELECT count(*) AS n FROM {source} u GROUP BY {', '.join(key)} HAVING count(*) > 1)"
    for tab, source in _KEYED.items() for key in quality.KEYS[tab]
) + """ UNION ALL SELECT 'articles again', 'article_id', count(*), CAST(2 * count(*) AS BIGINT) FROM articles WHERE article_id % 7 = 0
  UNION ALL SELECT 'assets', 'name', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM part_assets GROUP BY name HAVING count(*) > 1)"""


@query("K2", _DUPLICATES, "sources part_assets part_aliases stories articles mentions signals mood prices watchlists users")
def duplicate_keys(v):
    """Repeated values of every declared key; a seventh of the articles twice, and part names, show that repeats are found."""
    from newsmood.operators import mood

    tables = {
        "sources": v.sources, "assets": v.part_records, "asset_aliases": catalogue.alias_rows(v.part_records, catalogue.asset_rows(v.part_records)),
        "stories": v.stories, "articles": v.articles, "asset_mentions": v.mentions, "asset_signals": v.signals,
        "daily_mood": mood.daily_mood(v.signals, AS_OF), "daily_prices": v.prices, "watchlists": v.watchlists, "user_settings": v.users,
        "briefs": v.table("orders").select(
            F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), F.lit("standard").alias("level"),
            F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("watchlist_hash")),
    }
    assert set(tables) == set(quality.KEYS)
    again = v.articles.select("article_id")
    asked = [(tab, tables[tab], key) for tab, keys in quality.KEYS.items() for key in keys]
    asked += [("articles again", again.union(again.where("article_id % 7 = 0")), ["article_id"]), ("assets", v.part_records, ["name"])]
    parts = [
        quality.duplicate_keys(table, key).agg(
            F.count("*").alias("values_repeated"), F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("row_count")
        ).select(F.lit(tab).alias("tab"), F.lit(",".join(key)).alias("key"), "values_repeated", "row_count")
        for tab, table, key in asked
    ]
    return reduce(DataFrame.unionByName, parts)


@query("K3", "SELECT article_id, source_id FROM articles WHERE source_id NOT IN (SELECT source_id FROM sources)", "articles sources")
def orphan_articles(v):
    return quality.orphans(v.articles, v.sources, {"source_id": "source_id"}).select("article_id", "source_id")


@query("K3", """SELECT article_id, asset_id FROM mentions WHERE article_id NOT IN (SELECT a.article_id FROM articles a JOIN sources s USING (source_id) WHERE NOT is_active)""",
       "mentions articles sources")
def cascade_delete(v):
    """Mentions left after the articles of inactive sources were deleted with their source."""
    inactive = v.sources.where("NOT is_active")
    gone = v.articles.join(inactive.select("source_id"), "source_id", "left_semi")
    return quality.cascade_delete(v.mentions, gone, ["article_id"]).select("article_id", "asset_id")


@query("K3", """SELECT a.article_id, CASE WHEN t.story_id IS NULL THEN a.story_id END AS story_id FROM articles a
  LEFT JOIN (SELECT story_id FROM stories WHERE article_count < 8) t USING (story_id)""", "articles stories")
def set_null_stories(v):
    """Articles after the small stories were deleted."""
    small = v.stories.where("article_count < 8")
    return quality.set_null(v.articles, small, "story_id").select("article_id", "story_id")


@query("K4", """SELECT 'slug_format' AS problem, slug AS subject FROM part_assets WHERE NOT regexp_matches(slug, '^[a-z0-9-]{2,30}$')
  UNION ALL SELECT 'few_aliases', slug FROM part_assets LEFT JOIN (SELECT asset_id, count(*) n FROM part_aliases GROUP BY 1) USING (asset_id) WHERE coalesce(n, 0) < 2
  UNION ALL SELECT 'duplicate_slug', slug FROM part_assets GROUP BY slug HAVING count(*) > 1
  UNION ALL SELECT 'feed_not_https', feed_url FROM sources WHERE feed_url NOT LIKE 'https://%'""", "part_assets part_aliases sources")
def catalogue_problems(v):
    assets = catalogue.asset_rows(v.part_records)
    return quality.catalogue_problems(assets, catalogue.alias_rows(v.part_records, assets), v.sources)
