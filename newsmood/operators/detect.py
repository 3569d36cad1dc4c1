"""Asset detection: which assets an article mentions, and the sentences that show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text
from newsmood.operators.dedupe import unseen
from newsmood.session import checkpoint

_WORD = r"[\p{L}\p{N}]+"
_SIGN = r"[^\p{L}\p{N}\s]"
#: A catalogue of at most so many aliases (some 200 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ALIASES = 100_000


def alias_pattern(alias: Column, case_sensitive: Column) -> Column:
    """A whole-word regular expression: no letter or digit may touch either end."""
    escaped = F.regexp_replace(F.trim(alias), r"([.*+?^${}()|\[\]\\/])", r"\\$1")
    body = F.regexp_replace(escaped, r"\s+", r"\\s+")
    flags = F.when(case_sensitive, "").otherwise("(?iu)")
    return F.concat(flags, F.lit(r"(?<![\p{L}\p{N}])"), body, F.lit(r"(?![\p{L}\p{N}])"))


def compile_aliases(aliases: DataFrame) -> DataFrame:
    """asset_id, pattern and `keys` of every alias: its different words in lower case, the longest first, or its signs if it has no word.

    An alias starts and ends at a word edge, so a text that holds it holds all of its keys. Aliases of white space are left out.
    """
    found = lambda what: F.array_distinct(F.regexp_extract_all(F.lower("alias"), F.lit(what), F.lit(0)))
    longest_first = F.transform(
        F.array_sort(F.transform(found(_WORD), lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))), lambda x: x["word"])
    named = aliases.select(
        "asset_id", alias_pattern(F.col("alias"), F.col("is_case_sensitive")).alias("pattern"), longest_first.alias("words"), found(_SIGN).alias("signs"))
    return named.select("asset_id", "pattern", F.when(F.size("words") > 0, F.col("words")).otherwise(F.col("signs")).alias("keys"), (F.size("words") == 0).alias("is_signs")).where(
        F.size("keys") > 0)


def with_sentences(articles: DataFrame) -> DataFrame:
    """article_id and its numbered sentences, from title and body."""
    return articles.select("article_id", text.build_sentences(F.col("title"), F.col("body")).alias("sentences"))


def evidence_window(near: Column, hits: Column, limit: int | None = config.MAX_MENTION_SENTENCES) -> Column:
    """The sentences to keep, from the 0-based positions that mention the asset; without a limit all of them.

    `near` holds {i, s}: the mentioning sentences and their neighbours with their positions.
    Mentions take the places first, then their neighbours in the order of the mentions (left
    before right); the result is in text order.
    """
    first = lambda a: a if limit is None else F.slice(a, 1, limit)
    first_hits = first(F.array_sort(F.array_distinct(hits)))

    def window(n: Column) -> Column:
        known = F.transform(n, lambda x: x["i"])
        both_sides = lambda h: F.flatten(F.transform(h, lambda i: F.array(i - 1, i + 1)))
        chosen = text.let(
            first_hits,
            lambda h: first(F.array_distinct(F.concat(h, F.filter(both_sides(h), lambda i: F.array_contains(known, i))))),
        )
        kept = text.let(chosen, lambda c: F.filter(n, lambda x: F.array_contains(c, x["i"])))
        return F.transform(F.array_sort(kept), lambda x: x["s"])

    return text.let(F.array_distinct(near), window)


def _neighbours(sentences: Column, i: Column) -> Column:
    """{i, s} of the sentence at `i` and those next to it."""
    places = F.array(i - 1, i, i + 1)
    return F.filter(F.transform(places, lambda k: F.struct(k.alias("i"), F.get(sentences, k).alias("s"))), lambda x: x["s"].isNotNull())


def match_assets(
    sentenced: DataFrame, aliases: DataFrame, limit: int | None = config.MAX_MENTION_SENTENCES, broadcast_aliases: int = BROADCAST_ALIASES,
) -> DataFrame:
    """Mentions (article_id, asset_id, sentences) of each asset in each article, with at most `limit` sentences (None: all).

    Instead of testing every alias on every sentence, the words of a sentence meet the aliases on one word of the alias, and only what meets is tested. A catalogue of
    at most `broadcast_aliases` aliases is broadcast: words, meeting and test are one pass over the sentences, the text of a sentence is never copied or
    shuffled, and only hits leave the task, with the sentences next to them. A larger catalogue is shuffled; see `_hits_of_many`.
    """
    compiled = compile_aliases(aliases)
    known = compiled.groupBy("is_signs").count().collect()
    pattern = f"{_WORD}|{_SIGN}" if any(r["is_signs"] for r in known) else _WORD
    if sum(r["count"] for r in known) <= broadcast_aliases:
        small = F.broadcast(compiled.select("asset_id", "pattern", F.get("keys", F.lit(0)).alias("key")))
        each = sentenced.select("article_id", "sentences", F.posexplode("sentences").alias("i", "sentence"))
        met = each.select("*", F.explode(_keys(F.col("sentence.text"), pattern)).alias("key")).join(small, "key")
        hits = met.where(F.regexp("sentence.text", F.col("pattern"))).select("article_id", "asset_id", "i", _neighbours(F.col("sentences"), F.col("i")).alias("near"))
    else:
        hits = _hits_of_many(checkpoint(sentenced), compiled, pattern)
    if limit is not None:
        # Ranks are cut before the shuffle as well, so a long text that is full of an asset sends a few sentences only.
        place = F.dense_rank().over(Window.partitionBy("article_id", "asset_id").orderBy("i"))
        hits = hits.withColumn("place", place).where(F.col("place") <= limit)
    per_asset = hits.groupBy("article_id", "asset_id").agg(F.collect_set("i").alias("hits"), F.flatten(F.collect_set("near")).alias("near"))
    return per_asset.select("article_id", "asset_id", evidence_window(F.col("near"), F.col("hits"), limit).alias("sentences"))


def _keys(sentence: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit(pattern), F.lit(0)))


def _hits_of_many(sentenced: DataFrame, compiled: DataFrame, pattern: str) -> DataFrame:
    """article_id, asset_id, i and near (the sentence and its neighbours) of the sentences that mention an alias of a catalogue that is too large for a broadcast.

    An alias is met on its rarest word, counted over the sentences; one with a word that no sentence has is never met. Words travel without text, and the
    texts of sentences that met an alias come to them once.
    """
    words = sentenced.select("article_id", F.posexplode("sentences.text").alias("i", "text")).select("article_id", "i", F.explode(_keys(F.col("text"), pattern)).alias("key"))
    wanted = compiled.select("asset_id", "pattern", F.explode("keys").alias("key"))
    often = words.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("often"))
    counted = wanted.join(often, "key", "left").select("asset_id", "pattern", "key", F.coalesce("often", F.lit(0)).alias("often"))
    rarest = counted.groupBy("asset_id", "pattern").agg(F.min(F.struct("often", "key")).alias("least")).where("least.often > 0")
    anchored = checkpoint(rarest.select("asset_id", "pattern", F.col("least.key").alias("key")))
    met = words.join(anchored, "key").select("article_id", "i", "asset_id", "pattern").distinct()
    texts = sentenced.select("article_id", F.posexplode(F.transform("sentences", lambda s, i: F.struct(s["text"].alias("text"), _neighbours(F.col("sentences"), i).alias("near")))).alias("i", "sentence"))
    hits = met.join(texts, ["article_id", "i"]).where(F.regexp("sentence.text", F.col("pattern")))
    return hits.select("article_id", "asset_id", "i", "sentence.near")


def mention_rows(
    articles: DataFrame, aliases: DataFrame, stored: DataFrame | None = None, limit: int | None = config.MAX_MENTION_SENTENCES,
) -> DataFrame:
    """Mentions of a set of articles; with `stored`, only pairs that are not stored yet."""
    mentions = match_assets(with_sentences(articles), aliases, limit)
    return mentions if stored is None else unseen(mentions, stored, ["article_id", "asset_id"])


def rematch(articles: DataFrame, aliases: DataFrame, stored: DataFrame, as_of, days: int = 7) -> DataFrame:
    """New mentions in articles of the last `days` (1 to 30), for aliases added since."""
    if not 1 <= days <= 30:
        raise ValueError("days must be between 1 and 30")
    since = numbers.days_before(numbers.instant(as_of), days)
    return mention_rows(articles.where(F.col("fetched_at") >= since), aliases, stored)


def cited_sentences(sentences: Column, evidence_ids: Column) -> Column:
    """The stored sentences whose ids are cited; the quoted text never comes from an answer."""
    return F.filter(sentences, lambda s: F.array_contains(evidence_ids, s["id"]))


def flag_cited(sentences: Column, evidence_ids: Column) -> Column:
    """Every sentence with a flag that tells whether it is cited."""
    return F.transform(
        sentences,
        lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), F.array_contains(evidence_ids, s["id"]).alias("cited")),
    )
