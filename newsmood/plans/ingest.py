"""Queries on sources, feed items, deduplication, stories and asset detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmood.functions import numbers, text
from newsmood.operators import clean, dedupe, detect, health, reads, stories
from newsmood.plans import oracle_views as sql
from newsmood.plans.registry import query
from newsmood.plans.views import AS_OF, ITEM_BASE, stamp
from newsmood.session import scratch_path
from newsmood.sources import catalogue, feeds, labels_csv, sinks

STORED_BEFORE = "2024-01-29 00:00:00"


def _stamp_sql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# ---- sources -------------------------------------------------------------------------------


@query("A1", """SELECT url AS link, trim(regexp_extract(html, '(?i)<title>([\\s\\S]*?)</title>', 1)) AS title,
    CASE WHEN page_id % 2 = 0 THEN html ELSE 'short ' || page_id END AS summary,
    strftime(TIMESTAMP '2024-01-30 12:00:00' - INTERVAL (page_id % 10) DAY, '%Y-%m-%dT%H:%M:%SZ') AS date FROM pages""")
def feed_scan(v):
    """All pages landed as RSS and Atom files by Spark and read back as raw items, whole pages as summaries.

    By page id: an RSS description, one that is but a tag next to a summary, an Atom entry with content and summary, one whose content is but tags.
    """
    path = scratch_path(v.spark, "feeds")
    date = F.date_format("item_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    short = F.concat(F.lit("short "), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    rss = v.feed_items.where(kind < 2).select(
        "title", "link", F.when(kind == 0, F.col("summary")).otherwise("<br/>").alias("description"), F.when(kind == 1, short).alias("summary"), date.alias("pubDate"))
    atom = v.feed_items.where(kind >= 2).select(
        "title", "link", F.when(kind == 2, "a summary").otherwise(short).alias("summary"), F.when(kind == 2, F.col("summary")).otherwise("<p> </p>").alias("content"),
        date.alias("published"))
    feeds.write_rss(rss, path)
    feeds.write_atom(atom, path)
    return feeds.read_feeds(v.spark, path).select("link", F.trim("title").alias("title"), "summary", "date")


@query("A2", "SELECT source_id, name, feed_url, etag, last_modified, CAST(consecutive_failures AS BIGINT) AS consecutive_failures "
       "FROM sources WHERE is_active", "sources")
def active_sources(v):
    return health.active_sources(v.sources).withColumn("consecutive_failures", F.col("consecutive_failures").cast("long"))


@query("A3", """SELECT source_id, CASE WHEN outcome = 'error' AND consecutive_failures + 1 >= 5 THEN false ELSE is_active END AS is_active,
  CASE WHEN outcome = 'ok' THEN o.etag ELSE s.etag END AS etag, CASE WHEN outcome = 'ok' THEN NULL ELSE s.last_modified END AS last_modified,
  coalesce(status, last_status) AS last_status,
  CAST(CASE WHEN outcome = 'error' THEN consecutive_failures + 1 WHEN outcome IS NULL THEN consecutive_failures ELSE 0 END AS BIGINT) AS consecutive_failures
  FROM sources s LEFT JOIN outcomes o USING (source_id)""", "sources outcomes")
def source_health(v):
    return health.fold_outcomes(v.sources, v.outcomes, AS_OF).select(
        "source_id", "is_active", "etag", "last_modified", "last_status", F.col("consecutive_failures").cast("long")
    )


@query("A3", """SELECT count(*) AS sources, CAST(count_if(outcome = 'ok') AS BIGINT) AS fetched_ok,
  CAST(count_if(outcome = 'not_modified') AS BIGINT) AS not_modified, CAST(count_if(outcome = 'error') AS BIGINT) AS failed,
  CAST(count_if(outcome = 'error' AND consecutive_failures >= 4) AS BIGINT) AS deactivated
  FROM (SELECT * FROM sources WHERE is_active) LEFT JOIN outcomes USING (source_id)""", "sources outcomes")
def fetch_counters(v):
    return health.outcome_counts(v.sources, v.outcomes)


@query("A3 M5", """SELECT source_id, count(*) AS fetches, CAST(count_if(outcome = 'error' AND good_after = 0) AS BIGINT) AS consecutive_failures,
  count_if(outcome = 'error' AND good_after = 0) >= 5 AS deactivate
  FROM (SELECT *, count_if(outcome <> 'error') OVER (PARTITION BY source_id ORDER BY fetched_at DESC, fetch_id DESC) AS good_after FROM fetches)
  GROUP BY source_id""", "fetches")
def failure_streaks(v):
    return health.failure_streaks(v.fetches)


@query("A4", """SELECT feed, count(*) AS items, CAST(count_if(item_at > TIMESTAMP '2024-01-24') AS BIGINT) AS recent,
  strftime(max(item_at), '%Y-%m-%d %H:%M:%S') AS newest, count_if(item_at > TIMESTAMP '2024-01-24') > 0 AS accepted FROM feed_items GROUP BY feed""", "feed_items")
def feed_freshness(v):
    return health.feed_freshness(v.feed_items, AS_OF).withColumn("newest", stamp("newest"))


@query("A5", """SELECT url_hash, source_id, 'stored' AS origin FROM articles WHERE published_at IS NOT NULL
  UNION ALL SELECT url_hash, source_id, 'batch' FROM articles WHERE published_at IS NULL""", "articles")
def insert_ignore_sink(v):
    """All articles inserted over those with a publication time: stored rows stay."""
    rows = v.articles.select("url_hash", "source_id", "published_at")
    stored = rows.where("published_at IS NOT NULL").select("url_hash", "source_id", F.lit("stored").alias("origin"))
    batch = rows.select("url_hash", "source_id", F.lit("batch").alias("origin"))
    return sinks.insert_ignore(batch, stored, ["url_hash"], ["source_id"])


@query("A7", """SELECT asset_id, slug, name, asset_type, alias, is_case_sensitive FROM part_assets JOIN part_aliases USING (asset_id)""",
       "part_assets part_aliases")
def catalogue_load(v):
    assets = catalogue.asset_rows(v.part_records)
    aliases = catalogue.alias_rows(v.part_records, assets)
    return assets.join(aliases, "asset_id").select("asset_id", "slug", "name", "asset_type", "alias", "is_case_sensitive")


@query("A8", """SELECT 'ingest' AS job, '2024-01-30 12:00:00' AS started_at, '2024-01-31 00:00:00' AS finished_at, 'ok' AS status,
    '{"sources":' || count(*) || ',"fetched_ok":' || count_if(outcome = 'ok') || ',"not_modified":' || count_if(outcome = 'not_modified')
    || ',"failed":' || count_if(outcome = 'error') || ',"deactivated":' || count_if(outcome = 'error' AND consecutive_failures >= 4) || '}' AS stats
  FROM (SELECT * FROM sources WHERE is_active) LEFT JOIN outcomes USING (source_id)""", "sources outcomes")
def run_ledger(v):
    """A ledger row with the fetch counters of a run, appended to a table and read back."""
    path = scratch_path(v.spark, "job_runs")
    sinks.append_run(sinks.run_row(health.outcome_counts(v.sources, v.outcomes), "ingest", ITEM_BASE, AS_OF), path)
    return v.spark.read.schema(sinks.RUN_SCHEMA).parquet(path).select(
        "job", stamp("started_at").alias("started_at"), stamp("finished_at").alias("finished_at"), "status", "stats"
    )


@query("A9", r"""SELECT CAST(doc_id AS VARCHAR) AS example_id, trim(replace(text, chr(13), '')) AS numbered_sentences, source,
  CASE WHEN quality = 1 THEN 'bullish' WHEN quality = 0 THEN 'bearish' ELSE '' END AS gold_stance
  FROM documents LEFT JOIN labels USING (doc_id)""")
def labels_csv_round_trip(v):
    """Whole documents with their quotes and line breaks, written as label CSV and read back."""
    path = scratch_path(v.spark, "labels")
    docs = v.table("documents").join(v.table("labels"), "doc_id", "left")
    gold = F.when(F.col("quality") == 1, "bullish").when(F.col("quality") == 0, "bearish").otherwise("")
    labels_csv.write_labels(
        docs.select(
            F.col("doc_id").alias("example_id"), F.regexp_replace("text", "\r", "").alias("numbered_sentences"), "source",
            gold.alias("gold_stance"),
        ),
        path,
    )
    return labels_csv.read_labels(v.spark, path).select("example_id", "numbered_sentences", "source", "gold_stance")


@query("A11", f"""SELECT a.article_id, title, url, coalesce(s.name, 'Unknown source') AS source, {_stamp_sql('coalesce(published_at, fetched_at)')} AS published_at
  FROM articles a LEFT JOIN sources s USING (source_id) WHERE a.article_id IN (SELECT doc_id FROM labels)""", "articles sources")
def cited_article_lookup(v):
    ids = v.table("labels").select(F.col("doc_id").alias("article_id"))
    return reads.cited_articles(ids, v.articles, v.sources).withColumn("published_at", stamp("published_at"))


# ---- item cleaning -------------------------------------------------------------------------


@query("B1 B2", f"""SELECT page_id, sha256(body) AS body_hash, length(body) AS chars
  FROM (SELECT page_id, {sql.strip_html('html')} AS body FROM pages)""")
def strip_html(v):
    """Tags and entities out of whole pages; hashed so that the comparison stays small."""
    body = text.strip_html(F.col("html"))
    return v.table("pages").select("page_id", body.alias("body")).select(
        "page_id", F.sha2("body", 256).alias("body_hash"), F.length("body").cast("long").alias("chars")
    )


@query("B3 B4", "SELECT page_id, url, url_hash FROM clean_items", "clean_items")
def canonical_urls(v):
    return clean.normalise_items(v.feed_items, AS_OF).select("page_id", "url", "url_hash")


@query("B5", f"SELECT doc_id, {sql.truncate('body')} AS excerpt FROM (SELECT doc_id, {sql.collapse('text')} AS body FROM documents)")
def truncate_on_words(v):
    return v.table("documents").select("doc_id", text.truncate(text.collapse(F.col("text")), 500).alias("excerpt"))


@query("B6", f"SELECT page_id, {_stamp_sql('item_at')} AS published_at, item_at < TIMESTAMP '2024-01-24' AS too_old FROM feed_items", "feed_items")
def date_rule(v):
    now = numbers.instant(AS_OF)
    return v.feed_items.select("page_id", numbers.published_at(F.col("date"), now).alias("at")).select(
        "page_id", stamp("at").alias("published_at"), (F.col("at") < numbers.days_before(now, 7)).alias("too_old")
    )


@query("B7", f"""SELECT page_id, title, url, excerpt, {_stamp_sql('published_at')} AS published_at, reject_reason FROM clean_items""", "clean_items")
def normalise_items(v):
    return clean.normalise_items(v.feed_items, AS_OF).select(
        "page_id", "title", "url", "excerpt", stamp("published_at").alias("published_at"), "reject_reason"
    )


@query("B8", "SELECT reject_reason, count(*) AS items FROM clean_items WHERE reject_reason IS NOT NULL GROUP BY 1", "clean_items")
def skip_reasons(v):
    return clean.skip_reasons(clean.normalise_items(v.feed_items, AS_OF))


@query("B9 B10", "SELECT article_id, CAST(pos AS BIGINT) AS pos, sid, txt FROM sentences", "sentences")
def numbered_sentences(v):
    return detect.with_sentences(v.articles).select("article_id", F.posexplode("sentences").alias("pos", "s")).select(
        "article_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("s.id").alias("sid"), F.col("s.text").alias("txt")
    )


# ---- deduplication -------------------------------------------------------------------------


@query("C1", """SELECT url_key, page_id FROM (SELECT *, regexp_extract(url, '^https?://[^/]*') AS url_key FROM clean_items WHERE reject_reason IS NULL)
  QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY feed, page_id) = 1""", "clean_items")
def batch_dedupe(v):
    """The first accepted item of every site, as an example of a key with repeats."""
    good = clean.accepted(clean.normalise_items(v.feed_items, AS_OF)).withColumn(
        "url_key", F.regexp_extract("url", "^https?://[^/]*", 0)
    )
    return dedupe.first_per_key(good, ["url_key"], ["feed", "page_id"]).select("url_key", "page_id")


@query("C2", """SELECT url_hash, page_id FROM clean_items WHERE reject_reason IS NULL AND published_at >= TIMESTAMP '2024-01-28'""", "clean_items")
def new_versus_stored(v):
    """Accepted items whose hash is not among the stored ones (those older than three days)."""
    good = clean.accepted(clean.normalise_items(v.feed_items, AS_OF))
    stored = good.where(F.col("published_at") < F.lit("2024-01-28").cast("timestamp"))
    return dedupe.unseen(good, stored, ["url_hash"]).select("url_hash", "page_id")


# ---- stories -------------------------------------------------------------------------------


@query("D1 D2", "SELECT article_id, array_to_string(list_sort(sh), '|') AS shingles FROM shingle_sets", "shingle_sets")
def title_shingles(v):
    sh = F.array_sort(text.shingles(text.title_words(F.col("title"))))
    return v.articles.select("article_id", F.array_join(sh, "|").alias("shingles"))


_CHAIN = """
best AS (SELECT a AS id, b AS parent, sim, b_old FROM (
    SELECT s.*, {old_b} AS b_old, row_number() OVER (PARTITION BY a ORDER BY sim DESC, {old_b} DESC, tb, b) AS place
    FROM near_pairs s {join} WHERE NOT {old_a} AND ({old_b} OR tb < ta OR (tb = ta AND b < a))) WHERE place = 1),
chain(id, node, ended) AS (SELECT id, parent, b_old FROM best
    UNION ALL SELECT c.id, p.parent, p.b_old FROM chain c JOIN best p ON p.id = c.node WHERE NOT c.ended),
roots AS (SELECT c.id, c.node, c.ended FROM chain c WHERE c.ended OR NOT EXISTS (SELECT 1 FROM best p WHERE p.id = c.node))"""


@query("D3 D4", "SELECT id AS article_id, parent AS parent_id, round(sim, 6) AS similarity FROM best", "near_pairs articles",
       recursive=_CHAIN.format(old_a="false", old_b="false", join=""))
def similar_headlines(v):
    """The most similar earlier headline within 48 hours, one row per article that has one."""
    new = v.articles.select("article_id", "title", numbers.event_time().alias("at"))
    return stories.best_parents(new).select("article_id", "parent_id", F.round("similarity", 6).alias("similarity"))


@query("D5", """SELECT a.article_id, CAST(coalesce(r.node, a.article_id) AS VARCHAR) AS story_id, r.node IS NULL AS is_new_story,
  coalesce(floor(b.sim * 1000 + 0.5) / 1000, 1.0) AS similarity
  FROM articles a LEFT JOIN roots r ON r.id = a.article_id LEFT JOIN best b ON b.id = a.article_id""", "near_pairs articles",
       recursive=_CHAIN.format(old_a="false", old_b="false", join=""))
def story_assignment(v):
    """Stories of all articles, none stored before."""
    new = v.articles.select("article_id", "title", numbers.event_time().alias("at"))
    return stories.assign_stories(new)


def _pool_and_batch(v):
    cut = F.lit(STORED_BEFORE).cast("timestamp")
    stored = v.articles.where(F.col("fetched_at") < cut).withColumn("story_id", F.concat(F.lit("old-"), "source_id"))
    new = v.articles.where(F.col("fetched_at") >= cut).select("article_id", "title", numbers.event_time().alias("at"))
    return stories.recent_pool(stored, STORED_BEFORE), new


_POOLED = """pooled AS (SELECT article_id, fetched_at < TIMESTAMP '2024-01-29' AS old, source_id FROM articles
    WHERE fetched_at >= TIMESTAMP '2024-01-26'),
""" + _CHAIN.format(
    old_a="pa.old", old_b="pb.old",
    join="JOIN pooled pa ON pa.article_id = s.a JOIN pooled pb ON pb.article_id = s.b",
)


@query("D5 D6", """SELECT a.article_id, CASE WHEN r.ended THEN 'old-' || p.source_id ELSE CAST(coalesce(r.node, a.article_id) AS VARCHAR) END AS story_id,
  r.node IS NULL AS is_new_story, coalesce(floor(b.sim * 1000 + 0.5) / 1000, 1.0) AS similarity
  FROM pooled a LEFT JOIN roots r ON r.id = a.article_id LEFT JOIN best b ON b.id = a.article_id
  LEFT JOIN pooled p ON p.article_id = r.node WHERE NOT a.old""", "near_pairs articles", recursive=_POOLED)
def story_assignment_with_pool(v):
    """Stories of the newer articles when the older ones are stored with a story of their own."""
    recent, new = _pool_and_batch(v)
    return stories.assign_stories(new, recent)


@query("D6", """SELECT article_id, 'old-' || source_id AS story_id, strftime(coalesce(published_at, fetched_at), '%Y-%m-%d %H:%M:%S') AS event_at
  FROM articles WHERE fetched_at < TIMESTAMP '2024-01-29' AND fetched_at >= TIMESTAMP '2024-01-26'""", "articles")
def recent_story_pool(v):
    recent, _ = _pool_and_batch(v)
    return recent.select("article_id", "story_id", stamp("at").alias("event_at"))


@query("D7", """SELECT CAST(a.article_id AS VARCHAR) AS story_id, title AS headline, strftime(coalesce(published_at, fetched_at), '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  CAST(1 AS BIGINT) AS article_count, CAST(1 AS BIGINT) AS source_count FROM articles a WHERE a.article_id NOT IN (SELECT id FROM best)""",
       "near_pairs articles", recursive=_CHAIN.format(old_a="false", old_b="false", join=""))
def new_story_rows(v):
    new = v.articles.select("article_id", "title", numbers.event_time().alias("at"))
    return stories.new_story_rows(stories.assign_stories(new), new).withColumn("first_seen_at", stamp("first_seen_at")).drop("last_seen_at")


@query("D8", f"""SELECT story_id, article_count, source_count, {_stamp_sql('first_seen_at')} AS first_seen_at, {_stamp_sql('last_seen_at')} AS last_seen_at
  FROM stories""", "stories")
def refresh_stories(v):
    return stories.refresh_stories(v.articles).withColumns(
        {"first_seen_at": stamp("first_seen_at"), "last_seen_at": stamp("last_seen_at")}
    )


@query("D9", """SELECT count(*) AS articles_new, count(DISTINCT CASE WHEN s NOT LIKE 'old-%' THEN s END) AS stories_new,
  count(*) - count(DISTINCT CASE WHEN s NOT LIKE 'old-%' THEN s END) AS stories_joined FROM (
  SELECT CASE WHEN r.ended THEN 'old-' || p.source_id ELSE CAST(coalesce(r.node, a.article_id) AS VARCHAR) END AS s
  FROM pooled a LEFT JOIN roots r ON r.id = a.article_id LEFT JOIN pooled p ON p.article_id = r.node
  WHERE NOT a.old AND a.article_id IN (SELECT doc_id FROM labels))""", "near_pairs articles", recursive=_POOLED)
def ingest_counters(v):
    """Counters of a run that stored only the labelled articles of the batch."""
    recent, new = _pool_and_batch(v)
    stored = v.table("labels").select(F.col("doc_id").alias("article_id"))
    return stories.ingest_counters(stored, stories.assign_stories(new, recent))


# ---- asset detection -----------------------------------------------------------------------


@query("E1 E2", "SELECT article_id, asset_id, count(*) AS hit_sentences FROM hits GROUP BY 1, 2", "hits")
def asset_matches(v):
    """Sentences that mention each asset, counted over whole texts with the alias patterns."""
    rows = detect.with_sentences(v.articles).select("article_id", F.explode("sentences").alias("s")).select(
        "article_id", F.col("s.id").alias("sid"), F.array("s").alias("sentences")
    )
    single = rows.select(F.struct("article_id", "sid").alias("article_id"), "sentences")
    hits = detect.match_assets(single, v.aliases)
    return hits.groupBy("article_id.article_id", "asset_id").agg(F.count("*").alias("hit_sentences"))


@query("E3 E4", """SELECT article_id, asset_id, array_to_string(sids, ',') AS sids, array_to_string(texts, ' / ') AS texts FROM mentions""", "mentions")
def mention_rows(v):
    return v.mentions.select(
        "article_id", "asset_id",
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sids"),
        F.array_join(F.transform("sentences", lambda s: s["text"]), " / ").alias("texts"),
    )


@query("E3 E4", """SELECT article_id, asset_id, count(*) AS sentences, sha256(string_agg(sid || ':' || txt, chr(10) ORDER BY pos)) AS evidence_sha256 FROM (
  SELECT article_id, asset_id, pos FROM hits UNION SELECT article_id, asset_id, pos - 1 FROM hits UNION SELECT article_id, asset_id, pos + 1 FROM hits)
  JOIN sentences USING (article_id, pos) GROUP BY article_id, asset_id""", "hits sentences")
def all_mention_sentences(v):
    """Every sentence that mentions an asset and those next to it, without a limit, as a digest."""
    rows = detect.mention_rows(v.articles, v.aliases, limit=None)
    line = F.transform("sentences", lambda s: F.concat(s["id"], F.lit(":"), s["text"]))
    return rows.select(
        "article_id", "asset_id", F.size("sentences").cast("long").alias("sentences"), F.sha2(F.array_join(line, "\n"), 256).alias("evidence_sha256"))


@query("E5", """SELECT article_id, asset_id FROM mentions WHERE article_id IN (SELECT article_id FROM articles
  WHERE fetched_at >= TIMESTAMP '2024-01-29') AND (article_id, asset_id) NOT IN (SELECT article_id, asset_id FROM mention_signals)""",
       "mentions mention_signals articles")
def rematch_backfill(v):
    """Mentions of the last two days that are not stored yet."""
    return detect.rematch(v.articles, v.aliases, v.mention_signals, AS_OF, days=2).select("article_id", "asset_id")
