"""Queries on watchlists and briefs, all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import text
from newsmood.operators import briefs, mood
from newsmood.plans.registry import query
from newsmood.plans.views import AS_OF, Views, stamp, text_of

# The day with a mood for every asset; AS_OF itself has none.
MOOD_DAY = "2024-01-30 12:00:00"


def _mood(v: Views) -> DataFrame:
    return mood.daily_mood(v.signals, AS_OF)


@query("J1", """SELECT user_id, asset_id, 'add' AS change FROM (SELECT user_id, slug AS asset_id FROM requested EXCEPT SELECT user_id, asset_id FROM watchlists)
  UNION ALL SELECT user_id, asset_id, 'remove' FROM (SELECT user_id, asset_id FROM watchlists EXCEPT SELECT user_id, slug FROM requested)""", "requested watchlists")
def watchlist_changes(v):
    return briefs.watchlist_changes(v.requested.withColumnRenamed("slug", "asset_id"), v.watchlists)


@query("J2", """SELECT user_id, CAST(count(*) AS BIGINT) AS slugs, CASE WHEN count_if(NOT regexp_matches(slug, '^[a-z0-9-]{2,30}$')) > 0 OR count(*) NOT BETWEEN 3 AND 10
  THEN 'bad_selection' WHEN count_if(slug NOT IN (SELECT slug FROM assets)) > 0 THEN 'unknown_asset' END AS reason FROM requested GROUP BY user_id""", "requested assets")
def check_requests(v):
    return briefs.check_requests(v.requested, v.assets, "onboarding")


@query("J3", "SELECT user_id, count(*) AS assets FROM watchlists GROUP BY user_id HAVING count(*) > 7", "watchlists")
def over_cap(v):
    return briefs.over_cap(v.watchlists, cap=7)


@query("J4", "SELECT user_id, watchlist_hash FROM hashes", "hashes")
def watchlist_hashes(v):
    return briefs.watchlist_hashes(v.watchlists)


@query("J5", """SELECT user_id, asset_id, score, confidence, CAST(source_count AS BIGINT) AS source_count FROM watchlists JOIN mood USING (asset_id)
  WHERE day = DATE '2024-01-30'""", "watchlists mood")
def moods_of_day(v):
    return briefs.moods_of_day(v.watchlists, _mood(v), MOOD_DAY).select("user_id", "asset_id", "score", "confidence", "source_count")


_BRIEF_SIGNALS = """brief_signals AS (SELECT g.asset_id, article_id, coalesce(s.name, 'Unknown source') AS source, a.title,
    coalesce(a.published_at, a.fetched_at) AS published_at, stance, CAST(strength AS BIGINT) AS strength, why,
    coalesce(texts[list_position(sids, evidence_id)], '') AS evidence
    FROM mention_signals g JOIN articles a USING (article_id) LEFT JOIN sources s ON s.source_id = a.source_id
    LEFT JOIN mentions m USING (article_id, asset_id) WHERE status = 'ok' AND a.fetched_at >= TIMESTAMP '2024-01-30')"""


def _brief_signals(v: Views) -> DataFrame:
    return briefs.brief_signals(v.mention_signals, v.mentions, v.articles, v.sources, AS_OF)


@query("J6", "SELECT asset_id, article_id, source, title, stance, strength, why, evidence FROM brief_signals",
       "mention_signals articles sources mentions", recursive=_BRIEF_SIGNALS)
def brief_signals(v):
    return _brief_signals(v).select(
        "asset_id", "article_id", "source", "title", "stance", F.col("strength").cast("long"), "why",
        F.array_join("evidence", " / ").alias("evidence"),
    )


@query("J7", """SELECT asset_id, article_id, row_number() OVER (PARTITION BY asset_id ORDER BY strength DESC, published_at DESC, article_id) AS position
  FROM brief_signals QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY strength DESC, published_at DESC, article_id) <= 5""",
       "mention_signals articles sources mentions", recursive=_BRIEF_SIGNALS)
def top_signals(v):
    return briefs.top_signals(_brief_signals(v), config.SIGNALS_PER_ASSET).select("asset_id", "article_id", F.col("position").cast("long"))


@query("J8")
def brief_payloads(v):
    top = briefs.top_signals(_brief_signals(v), config.SIGNALS_PER_ASSET)
    return briefs.brief_payloads(v.watchlists, v.assets, _mood(v), top, MOOD_DAY)


@query("J8", """SELECT user_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS signals FROM watchlists LEFT JOIN (
  SELECT asset_id, least(5, count(*)) AS n FROM brief_signals GROUP BY 1) USING (asset_id) GROUP BY user_id""",
       "mention_signals articles sources mentions watchlists", recursive=_BRIEF_SIGNALS)
def brief_payload_sizes(v):
    top = briefs.top_signals(_brief_signals(v), config.SIGNALS_PER_ASSET)
    return briefs.brief_payloads(v.watchlists, v.assets, _mood(v), top, MOOD_DAY).select("user_id", "signals")


_ANSWER_SQL = """answered AS (SELECT event_id, user_id, v % 4 AS n, k, event_type FROM ev)"""


def _answers(v: Views) -> DataFrame:
    """Raw brief answers with 2 to 5 bullets; clicks write an empty text, errors are no JSON."""
    body = F.when(F.col("event_type") == "click", "").otherwise("Gold moved.")
    bullet = lambda i: F.concat(
        F.lit('{"text": "'), body, F.lit('", "asset_slugs": ["a01"], "article_ids": ["'), i.cast("string"), F.lit('"]}')
    )
    answer = F.concat(
        F.lit('{"bullets": ['),
        F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.floor("value") % 4 + 1), bullet), ", "),
        F.lit("]}"),
    )
    return v.events.select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", "no json").otherwise(answer).alias("answer")
    )


@query("J9", "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') AND n >= 1 THEN CAST(n + 2 AS BIGINT) END AS bullets FROM answered",
       "ev", recursive=_ANSWER_SQL)
def bullet_shapes(v):
    parsed = briefs.parse_bullets(_answers(v))
    return parsed.select("event_id", F.when(F.col("bullets").isNotNull(), F.size("bullets")).cast("long").alias("bullets"))


_BULLET_CHECK = r"""slugs AS (SELECT user_id, bullet_no, unnest(asset_slugs) AS slug, unnest(range(1, 3)) AS pos FROM bullets),
  cited AS (SELECT user_id, bullet_no, unnest(article_ids) AS aid, unnest(range(1, 3)) AS pos FROM bullets),
  offered AS (SELECT DISTINCT user_id, 'art' || (k % 8) AS aid FROM ev),
  bad_slug AS (SELECT bullet_no, arg_min(slug, pos) AS slug FROM slugs WHERE (user_id, slug) NOT IN (SELECT user_id, asset_id FROM watchlists) GROUP BY 1),
  bad_id AS (SELECT bullet_no, arg_min(aid, pos) AS aid FROM cited WHERE (user_id, aid) NOT IN (SELECT user_id, aid FROM offered) GROUP BY 1),
  checked AS (SELECT b.user_id, b.bullet_no, trim(txt) AS txt, asset_slugs, article_ids,
    CASE WHEN s.slug IS NOT NULL THEN 'asset not on watchlist: ' || s.slug WHEN i.aid IS NOT NULL THEN 'unknown article id: ' || i.aid
         WHEN txt LIKE 'You should%' THEN 'banned phrase: buy' WHEN txt LIKE 'Investors SELL%' THEN 'banned phrase: sell'
         WHEN txt LIKE '%price  target%' THEN 'banned phrase: price target' END AS reason
    FROM bullets b LEFT JOIN bad_slug s USING (bullet_no) LEFT JOIN bad_id i USING (bullet_no))"""


def _checked(v: Views) -> DataFrame:
    return briefs.check_bullets(v.bullets, v.watchlists.withColumnRenamed("asset_id", "slug"), v.offered_articles)


@query("J10", """SELECT user_id, bullet_no, txt, reason, CASE WHEN asset_slugs[1] = asset_slugs[2] THEN asset_slugs[1] ELSE array_to_string(asset_slugs, ',') END AS slugs
  FROM checked""", "bullets watchlists ev", recursive=_BULLET_CHECK)
def check_bullets(v):
    return _checked(v).select("user_id", "bullet_no", F.col("text").alias("txt"), "reason", F.array_join("asset_slugs", ",").alias("slugs"))


def _phrase_sql(expr: str) -> str:
    edge = r"[^\p{L}\p{N}]"
    cases = " ".join(
        f"WHEN regexp_matches({expr}, '(^|{edge}){p.replace(' ', chr(92) + 's+')}($|{edge})', 'i') THEN '{p}'"
        for p in ("buy", "sell", "should", "guaranteed", "will rise", "will fall", "price target")
    )
    return f"CASE {cases} END"


@query("J11", r"SELECT phrase, count(*) AS texts FROM (SELECT " + _phrase_sql(r"regexp_replace(txt, '\b(sell-?offs?|buy-?backs?)\b', ' ', 'gi')")
       + " AS phrase FROM (SELECT txt FROM bullets UNION ALL SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY 1", "bullets")
def banned_phrases(v):
    """Advice phrases in bullets, whole documents and whole conversation turns."""
    texts = v.bullets.select("text").unionByName(v.table("documents").select("text")).unionByName(v.table("conversations").select("text"))
    return texts.groupBy(text.banned_phrase(F.col("text")).alias("phrase")).agg(F.count("*").alias("texts"))


_TEMPLATE = """template AS (SELECT user_id, place AS bullet_no, asset_id AS slug, CASE WHEN score IS NULL THEN name || ': no scored news yet today.'
    ELSE name || ': ' || word || ' today' || CASE WHEN level = 'beginner' AND word <> 'mixed' THEN ' (' || CASE WHEN contains(word, 'hawkish')
      THEN 'hawkish = leaning towards higher rates' WHEN contains(word, 'dovish') THEN 'dovish = leaning towards lower rates'
      WHEN contains(word, 'bullish') THEN 'bullish = news pointing up' ELSE 'bearish = news pointing down' END || ')' ELSE '' END
      || ', ' || source_count || ' source' || CASE WHEN source_count = 1 THEN '' ELSE 's' END || ', ' || confidence || ' confidence.' END AS txt
    FROM (SELECT *, CASE WHEN score >= 0.5 THEN 'mostly ' || up WHEN score >= 0.15 THEN 'leaning ' || up WHEN score > -0.15 THEN 'mixed'
            WHEN score > -0.5 THEN 'leaning ' || down ELSE 'mostly ' || down END AS word
      FROM (SELECT w.user_id, w.asset_id, row_number() OVER (PARTITION BY w.user_id ORDER BY added_at, w.asset_id) AS place, name, level, score,
              source_count, confidence, CASE WHEN asset_type = 'central_bank' THEN 'hawkish' ELSE 'bullish' END AS up,
              CASE WHEN asset_type = 'central_bank' THEN 'dovish' ELSE 'bearish' END AS down
            FROM watchlists w JOIN assets USING (asset_id) JOIN users u ON u.user_id = w.user_id
            LEFT JOIN (SELECT * FROM mood WHERE day = DATE '2024-01-30' AND asset_id <> 'a03') m ON m.asset_id = w.asset_id)
      WHERE place <= 5))"""


def _template(v: Views) -> DataFrame:
    return briefs.template_bullets(v.watchlists, v.assets, _mood(v).where("asset_id <> 'a03'"), v.users.select("user_id", "level"), MOOD_DAY)


@query("J12", "SELECT user_id, bullet_no, txt, slug FROM template", "watchlists assets users mood", recursive=_TEMPLATE)
def template_bullets(v):
    """Template sentences; one asset is left without a mood on that day."""
    return _template(v).select("user_id", F.col("bullet_no").cast("long"), F.col("text").alias("txt"), F.get("asset_slugs", F.lit(0)).alias("slug"))


@query("J13", """SELECT user_id, bullet_no, txt, 'ai' AS source FROM checked WHERE reason IS NULL AND user_id IN (SELECT user_id FROM checked WHERE reason IS NULL GROUP BY 1 HAVING count(*) >= 2)
  UNION ALL SELECT user_id, bullet_no, txt, 'template' FROM template WHERE user_id NOT IN (SELECT user_id FROM checked WHERE reason IS NULL GROUP BY 1 HAVING count(*) >= 2)""",
       "bullets watchlists ev assets users mood", recursive=_BULLET_CHECK + ", " + _TEMPLATE)
def selected_briefs(v):
    template = _template(v).withColumn("bullet_no", F.col("bullet_no").cast("long"))
    return briefs.select_briefs(_checked(v), template).select("user_id", "bullet_no", F.col("text").alias("txt"), "source")


def _requests(v: Views) -> DataFrame:
    return briefs.watchlist_hashes(v.watchlists).join(v.users.select("user_id", "level"), "user_id").withColumn("day", F.to_date(F.lit("2024-01-30")))


@query("J14", """SELECT user_id, level, watchlist_hash, stored_source, stored_source IS NULL AS needs_generation FROM (
  SELECT h.user_id, level, watchlist_hash, CASE WHEN beginner_mode THEN 'ai' END AS stored_source FROM hashes h JOIN users USING (user_id))""", "hashes users")
def stored_brief_lookup(v):
    """Briefs are stored for beginners only; all others need one."""
    stored = _requests(v).where("level = 'beginner'").withColumn("source", F.lit("ai"))
    return briefs.lookup_stored(_requests(v), stored).select("user_id", "level", "watchlist_hash", "stored_source", "needs_generation")


@query("J15", """SELECT u.user_id, coalesce(n, 0) AS created, CASE WHEN w.user_id IS NULL THEN 'empty_watchlist' WHEN n >= 10 THEN 'limit_reached' ELSE 'ok' END AS status
  FROM users u LEFT JOIN (SELECT DISTINCT user_id FROM watchlists) w USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n FROM briefs_log WHERE created_at >= TIMESTAMP '2024-01-31' GROUP BY 1) b ON b.user_id = u.user_id""", "users watchlists briefs_log")
def quota_status(v):
    return briefs.quota_status(v.users, v.watchlists, v.briefs_log, "2024-01-31 12:00:00")


@query("J16", """SELECT DISTINCT b.user_id, a.article_id, title, coalesce(s.name, 'Unknown source') AS source,
  strftime(coalesce(published_at, fetched_at), '%Y-%m-%d %H:%M:%S') AS published_at FROM (SELECT user_id, unnest([k, v % 50]) AS aid FROM ev) b
  JOIN articles a ON a.article_id = b.aid LEFT JOIN sources s USING (source_id)""", "ev articles sources")
def brief_articles(v):
    bullets = v.events.select("user_id", F.array(F.col("k").cast("string"), (F.floor("value").cast("long") % 50).cast("string")).alias("article_ids"))
    return briefs.brief_articles(bullets, v.articles, v.sources).select(
        "user_id", "article_id", "title", "source", stamp("published_at").alias("published_at")
    )


@query("J13 J14 A5")
def briefs_to_store(v):
    """Template briefs of all users nested into rows to save."""
    bullets = _template(v).withColumn("source", F.lit("template"))
    stored = briefs.stored_briefs(bullets, _requests(v), MOOD_DAY)
    return stored.select("user_id", text_of("day").alias("day"), "level", "watchlist_hash", F.to_json("bullets").alias("bullets"), "source")
