"""Watchlists and daily briefs, for all users in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text
from newsmood.operators import detect
from newsmood.operators.reads import with_source

BULLETS = "array<struct<text:string,asset_slugs:array<string>,article_ids:array<string>>>"


def watchlist_changes(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to add and rows to remove (user_id, asset_id, change) so that stored equals requested.

    Only users with a request are touched.
    """
    keys = ["user_id", "asset_id"]
    wanted = requested.select(*keys).distinct()
    have = stored.select(*keys).distinct()
    add = wanted.join(have, keys, "left_anti").withColumn("change", F.lit("add"))
    remove = (
        have.join(wanted.select("user_id").distinct(), "user_id", "left_semi")
        .join(wanted, keys, "left_anti")
        .select(*keys)
        .withColumn("change", F.lit("remove"))
    )
    return add.unionByName(remove)


def check_requests(requested: DataFrame, assets: DataFrame, mode: str = "watchlist") -> DataFrame:
    """One verdict per user's request (user_id, slug rows): reason is NULL when it is accepted.

    Slugs must have the right form, their distinct number must lie within the mode's limits, and
    all must be in the catalogue; otherwise the whole request is refused.
    """
    low, high = config.WATCHLIST_LIMITS[mode]
    distinct = requested.select("user_id", "slug").distinct()
    checked = distinct.join(assets.select("slug", F.lit(True).alias("in_catalogue")), "slug", "left")
    counted = checked.groupBy("user_id").agg(
        F.count("*").alias("slugs"),
        F.count_if(~F.col("slug").rlike(config.SLUG_PATTERN)).alias("malformed"),
        F.count_if(F.col("in_catalogue").isNull()).alias("unknown"),
    )
    reason = F.when((F.col("malformed") > 0) | ~F.col("slugs").between(low, high), "bad_selection").when(
        F.col("unknown") > 0, "unknown_asset"
    )
    return counted.select("user_id", "slugs", reason.alias("reason"))


def over_cap(watchlists: DataFrame, cap: int = config.WATCHLIST_CAP) -> DataFrame:
    """Users with more rows than the cap."""
    return watchlists.groupBy("user_id").agg(F.count("*").alias("assets")).where(F.col("assets") > cap)


def watchlist_hashes(watchlists: DataFrame) -> DataFrame:
    """sha256 of each user's sorted asset ids; a watchlist is at most as long as the catalogue."""
    ids = F.array_sort(F.collect_set(F.col("asset_id").cast("string")))
    return watchlists.groupBy("user_id").agg(F.sha2(F.array_join(ids, ","), 256).alias("watchlist_hash"))


def moods_of_day(watchlists: DataFrame, mood: DataFrame, as_of) -> DataFrame:
    """Today's mood of every watched asset that has one."""
    today = mood.where(F.col("day") == F.to_date(numbers.instant(as_of)))
    return watchlists.select("user_id", "asset_id").join(
        today.select("asset_id", "score", "confidence", "source_count", "article_count"), "asset_id"
    )


def brief_signals(
    signals: DataFrame, mentions: DataFrame, articles: DataFrame, sources: DataFrame, as_of, hours: int = 24
) -> DataFrame:
    """ok signals by arrival window with article, source and the cited sentences as evidence."""
    since = numbers.hours_before(numbers.instant(as_of), hours)
    recent = articles.where(F.col("fetched_at") >= since).select(
        "article_id", "title", "url", "source_id", numbers.event_time().alias("published_at")
    )
    joined = with_source(signals.where("status = 'ok'").join(recent, "article_id"), sources).join(
        mentions.select("article_id", "asset_id", "sentences"), ["article_id", "asset_id"], "left"
    )
    cited = detect.cited_sentences(F.col("sentences"), F.col("evidence_ids"))
    return joined.select(
        "asset_id", "article_id", "source", "title", "url", "published_at", "stance", "strength", "why",
        F.coalesce(F.transform(cited, lambda s: s["text"]), F.array().cast("array<string>")).alias("evidence"),
    )


def top_signals(signals: DataFrame, per_asset: int) -> DataFrame:
    """The `per_asset` strongest, then newest signals of each asset, with their position."""
    order = Window.partitionBy("asset_id").orderBy(F.desc("strength"), F.desc("published_at"), F.asc("article_id"))
    return signals.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_asset)


def brief_payloads(watchlists: DataFrame, assets: DataFrame, mood: DataFrame, top: DataFrame, as_of) -> DataFrame:
    """One JSON document per user: every watched asset with its mood and its top signals.

    The nested lists are bounded: five signals per asset and the watchlist's own length. The
    signals are nested per asset once and joined to the users who watch it.
    """
    nested = top.groupBy("asset_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "article_id", "source", "stance", "strength", "why", "evidence"))),
            lambda s: s.dropFields("position"),
        ).alias("signals")
    )
    today = mood.where(F.col("day") == F.to_date(numbers.instant(as_of))).select(
        "asset_id", F.struct("score", "confidence", F.col("source_count").alias("sources")).alias("mood_today")
    )
    per_asset = (
        assets.join(today, "asset_id", "left")
        .join(nested, "asset_id", "left")
        .withColumn("signals", F.coalesce("signals", F.array().cast(nested.schema["signals"].dataType)))
    )
    entry = F.struct("added_at", "asset_id", F.struct("slug", "name", F.col("asset_type").alias("type"), "mood_today", "signals").alias("a"))
    listed = watchlists.join(per_asset, "asset_id").groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["a"]).alias("payload"),
        F.sum(F.size("signals")).alias("signals"),
    )
    body = text.neutralise_tags(F.to_json("payload"))
    return listed.select(
        "user_id", "signals", F.concat(F.lit("<signals>\n"), body, F.lit("\n</signals>")).alias("user_text")
    )


def parse_bullets(answers: DataFrame) -> DataFrame:
    """Bullets of a raw answer, NULL unless their shape is right.

    3 to 5 bullets, text of 1 to 280 characters, 1 to 5 slugs, 1 to 4 article ids.
    """
    parsed = F.try_variant_get(F.try_parse_json("answer"), "$.bullets", BULLETS)
    shaped = F.forall(
        parsed,
        lambda b: F.coalesce(
            F.length(b["text"]).between(1, 280) & F.size(b["asset_slugs"]).between(1, 5) & F.size(b["article_ids"]).between(1, 4)
            & F.forall(b["asset_slugs"], lambda s: s.isNotNull()) & F.forall(b["article_ids"], lambda s: s.isNotNull()),
            F.lit(False),
        ),
    )
    return answers.withColumn(
        "bullets", F.when(F.size(parsed).between(3, 5) & shaped, parsed)
    )


def check_bullets(bullets: DataFrame, watch_slugs: DataFrame, known_articles: DataFrame) -> DataFrame:
    """Every bullet with the first reason to drop it, or NULL when it is kept.

    `bullets`: user_id, bullet_no, text, asset_slugs, article_ids. `watch_slugs`: user_id, slug.
    `known_articles`: user_id, article_id offered to that user. Reasons in order: a slug that is
    not on the watchlist, an unknown article id, a banned phrase. Kept text is trimmed and the ids
    are without repeats.
    """
    keys = ["user_id", "bullet_no"]
    slugs = bullets.select(*keys, F.posexplode("asset_slugs").alias("pos", "slug"))
    bad_slugs = (
        slugs.join(watch_slugs.select("user_id", "slug").distinct(), ["user_id", "slug"], "left_anti")
        .groupBy(*keys).agg(F.min_by("slug", "pos").alias("bad_slug"))
    )
    cited = bullets.select(*keys, F.posexplode("article_ids").alias("pos", "article_id"))
    bad_ids = (
        cited.join(known_articles.select("user_id", "article_id").distinct(), ["user_id", "article_id"], "left_anti")
        .groupBy(*keys).agg(F.min_by("article_id", "pos").alias("bad_id"))
    )
    banned = text.banned_phrase(F.col("text"))
    reason = (
        F.when(F.col("bad_slug").isNotNull(), F.concat(F.lit("asset not on watchlist: "), "bad_slug"))
        .when(F.col("bad_id").isNotNull(), F.concat(F.lit("unknown article id: "), "bad_id"))
        .when(banned.isNotNull(), F.concat(F.lit("banned phrase: "), banned))
    )
    return (
        bullets.join(bad_slugs, keys, "left").join(bad_ids, keys, "left")
        .select(
            *keys, F.trim("text").alias("text"), F.array_distinct("asset_slugs").alias("asset_slugs"),
            F.array_distinct("article_ids").alias("article_ids"), reason.alias("reason"),
        )
    )


def template_bullets(watchlists: DataFrame, assets: DataFrame, mood: DataFrame, levels: DataFrame, as_of) -> DataFrame:
    """One sentence on each of the first five watched assets, from today's mood only.

    `levels`: user_id, level (standard or beginner).
    """
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("added_at", "asset_id"))
    first = watchlists.withColumn("bullet_no", position).where(F.col("bullet_no") <= config.TEMPLATE_ASSETS)
    today = mood.where(F.col("day") == F.to_date(numbers.instant(as_of))).select(
        "asset_id", "score", "confidence", "source_count"
    )
    rows = first.join(assets, "asset_id").join(levels, "user_id").join(today, "asset_id", "left")
    word = numbers.mood_word(F.col("score"), F.col("asset_type"))
    hint = F.coalesce(*[F.when(word.contains(w), F.lit(text)) for w, text in config.WORD_HINTS.items()])
    plain = F.when((F.col("level") == "beginner") & (word != "mixed"), F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise("")
    plural = F.when(F.col("source_count") == 1, "").otherwise("s")
    scored = F.format_string(config.SCORED_SENTENCE, "name", word, plain, "source_count", plural, "confidence")
    sentence = F.when(F.col("score").isNull(), F.format_string(config.UNSCORED_SENTENCE, "name")).otherwise(scored)
    return rows.select(
        "user_id", "bullet_no", sentence.alias("text"), F.array("slug").alias("asset_slugs"),
        F.array().cast("array<string>").alias("article_ids"),
    )


def select_briefs(checked: DataFrame, template: DataFrame) -> DataFrame:
    """Kept model bullets for users with at least two of them, the template for all others."""
    kept = checked.where("reason IS NULL").drop("reason")
    enough = kept.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= config.MIN_KEPT_BULLETS).select("user_id")
    modelled = kept.join(enough, "user_id", "left_semi").withColumn("source", F.lit("ai"))
    return modelled.unionByName(template.join(enough, "user_id", "left_anti").withColumn("source", F.lit("template")))


def lookup_stored(requests: DataFrame, briefs: DataFrame) -> DataFrame:
    """Requests (user_id, day, level, watchlist_hash) with the stored brief's source, or NULL."""
    keys = ["user_id", "day", "level", "watchlist_hash"]
    return requests.join(briefs.select(*keys, F.col("source").alias("stored_source")), keys, "left").withColumn(
        "needs_generation", F.col("stored_source").isNull()
    )


def quota_status(users: DataFrame, watchlists: DataFrame, briefs: DataFrame, as_of) -> DataFrame:
    """Per user: empty_watchlist, limit_reached (ten briefs created today) or ok."""
    midnight = F.to_date(numbers.instant(as_of)).cast("timestamp")
    today = briefs.where(F.col("created_at") >= midnight).groupBy("user_id").agg(F.count("*").alias("created"))
    listed = watchlists.select("user_id").distinct().withColumn("listed", F.lit(True))
    created = F.coalesce("created", F.lit(0).cast("long"))
    return (
        users.select("user_id").distinct().join(listed, "user_id", "left").join(today, "user_id", "left")
        .select(
            "user_id", created.alias("created"),
            F.when(F.col("listed").isNull(), "empty_watchlist")
            .when(created >= config.MAX_BRIEFS_PER_DAY, "limit_reached").otherwise("ok").alias("status"),
        )
    )


def brief_articles(bullets: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct articles each user's bullets cite, with their source."""
    cited = bullets.select("user_id", F.explode("article_ids").alias("cited_id")).distinct()
    found = cited.join(
        articles.withColumn("cited_id", F.col("article_id").cast("string")), "cited_id"
    )
    return with_source(found, sources).select(
        "user_id", "article_id", "title", "url", "source", numbers.event_time().alias("published_at")
    )


def stored_briefs(bullets: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Brief rows to save: the (at most five) bullets of a user nested in order."""
    entry = F.struct("bullet_no", "text", "asset_slugs", "article_ids")
    nested = bullets.groupBy("user_id", "source").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda b: b.dropFields("bullet_no")).alias("bullets")
    )
    return requests.join(nested, "user_id").select(
        "user_id", "day", "level", "watchlist_hash", "bullets", "source", numbers.instant(as_of).alias("created_at")
    )
