"""Story grouping: similar headlines within 48 hours belong to one story.

An article joins the story of its most similar earlier article. That best article depends only on
titles and times, never on the stories already given, so every article has one fixed parent and
its story is the root of its chain of parents. Nothing here runs one article after the other.

How the work stays small on skewed data:

* copies of a headline are one shingle set, and an article with an earlier copy in its window is
  settled by an as-of lookup, without any comparison;
* a shingle that only one set holds can never be shared, so sets that differ only in such shingles
  (templates with a number or a date in them) are one class and are compared once;
* classes meet on a shingle that at most FREQUENT_SHINGLE sets hold, only if sizes and positions
  still allow the threshold, and only if they are active within the window of each other;
* two headlines that share frequent shingles only are as similar as their frequent parts say, so
  for those pairs all classes with the same frequent part are one family, and families are matched
  instead of classes: a template filled with thousands of names is one family;
* families that meet on a shingle of more than LONG_LIST families are not compared with each other: they meet on that
  shingle and the next one, then on three, and so on (see `similar_families`). What is still a long list when the shingles of the key
  alone reach the threshold is one group of similar headlines;
* within a matched class, family or group, the first member in the window comes from the same as-of
  lookup. A family or group may understate the similarity of a member that shares more shingles;
  that member's own class, or a longer key, then brings its true, higher value.

So no list of all pairs within a group of similar headlines is ever built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text
from newsmood.operators.asof import first_at_or_after
from newsmood.session import checkpoint

_SEP = "\u0001"
# A shingle that more distinct headlines than this hold counts as frequent.
FREQUENT_SHINGLE = 200
# Families of a key that more of them have are told apart by a longer key instead of being compared.
LONG_LIST = 1000


def with_shingles(articles: DataFrame) -> DataFrame:
    """Adds shingles (sorted set) and the key of that set; titles without content words drop out."""
    return (
        articles.withColumn("shingles", F.array_sort(text.shingles(text.title_words(F.col("title")))))
        .where(F.size("shingles") > 0)
        .withColumn("set_key", F.sha2(F.array_join("shingles", _SEP), 256))
    )


def _overlap_needed(n: Column, m: Column, threshold: float) -> Column:
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _class_key(kind: str) -> Column:
    return F.sha2(F.concat_ws(_SEP, F.lit(kind), F.col("n").cast("string"), F.array_join("tokens", _SEP)), 256)


def _reaches(threshold: float) -> Column:
    """Whether enough tokens are left to reach the threshold with any other set."""
    return F.size("tokens") >= F.ceil(F.col("n") * threshold - 1e-9)


def shingle_classes(
    sets: DataFrame, threshold: float = config.JOIN_THRESHOLD, frequent: int = FREQUENT_SHINGLE
) -> DataFrame:
    """set_key, n, tokens, rare, class_key of every set that can be similar to another one.

    `tokens` are the shingles that at least two sets hold, rarest first, and `rare` is how many of
    them at most `frequent` sets hold. Two different sets share exactly the shingles their classes
    share, so similarity is a property of the classes.
    """
    postings = sets.select("set_key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = postings.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    return (
        postings.join(shared, "shingle")
        .groupBy("set_key", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("counted"))
        .select(
            "set_key", "n", F.col("counted.shingle").alias("tokens"),
            F.size(F.filter("counted", lambda t: t["df"] <= frequent)).alias("rare"),
        )
        .where(_reaches(threshold))
        .withColumn("class_key", _class_key("class"))
    )


def shingle_families(classes: DataFrame, threshold: float = config.JOIN_THRESHOLD) -> DataFrame:
    """set_key, n, tokens, class_key of the frequent parts, for sets where these reach far enough."""
    return (
        classes.withColumn("tokens", F.slice("tokens", F.col("rare") + 1, F.size("tokens")))
        .where((F.size("tokens") > 0) & _reaches(threshold))
        .select("set_key", "n", "tokens", F.size("tokens").alias("rare"), _class_key("family").alias("class_key"))
    )


def _needed_at_least(threshold: float) -> Column:
    """Shared tokens without which a set is similar to no other."""
    return F.ceil(F.col("n") * threshold - 1e-9)


def _prefix(threshold: float) -> Column:
    """The rarest tokens of which two similar classes must share at least one, with positions.

    Only rare tokens: a pair that shares a rare token has it as its first common one.
    """
    length = F.least(F.size("tokens") - _needed_at_least(threshold) + 1, F.col("rare")).cast("int")
    return F.posexplode(F.slice("tokens", 1, length)).alias("pos", "key")


def _sides(probes: DataFrame, candidates: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a comparison, one row per key. A probe looks at its own time block and those next to it."""
    left = probes.select(
        F.col("class_key").alias("probe_class"), F.col("block").alias("probe_block"), F.col("n").alias("probe_n"), F.col("tokens").alias("probe_tokens"),
        _prefix(threshold),
    ).withColumnRenamed("pos", "probe_pos").withColumn("block", F.explode(F.sequence(F.col("probe_block") - 1, F.col("probe_block") + 1)))
    return left, candidates.select("class_key", "n", "tokens", "is_stored", "block", _prefix(threshold))


def _compared(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs that meet on a key and reach the threshold: probe_class, probe_block, class_key, is_stored, similarity."""
    needed = _overlap_needed(F.col("probe_n"), F.col("n"), threshold)
    # Shared tokens up to this one, and those that can still follow it.
    reach = F.least("probe_pos", "pos") + 1 + F.least(
        F.size("probe_tokens") - F.col("probe_pos") - 1, F.size("tokens") - F.col("pos") - 1
    )
    common = F.size(F.array_intersect("probe_tokens", "tokens"))
    return (
        left.join(right, ["key", "block"])
        .where(F.col("is_stored") | (F.col("block") <= F.col("probe_block")))
        .where((F.col("n") >= F.col("probe_n") * threshold) & (F.col("probe_n") >= F.col("n") * threshold))
        .where(reach >= needed)
        .withColumn("similarity", common / (F.col("probe_n") + F.col("n") - common))
        .where(F.col("similarity") >= threshold)
        .select("probe_class", "probe_block", "class_key", "is_stored", "similarity")
        .distinct()
    )


def similar_classes(
    probes: DataFrame, candidates: DataFrame, threshold: float = config.JOIN_THRESHOLD
) -> DataFrame:
    """Pairs of classes with Jaccard similarity >= threshold that are active near each other.

    `probes`: class_key, n, tokens, rare, block. `candidates`: the same and is_stored. A probe looks at
    its own time block and the one before, and for stored articles also at the next one. Exact:
    every filter only removes pairs that cannot reach the threshold.
    """
    return _compared(*_sides(probes, candidates, threshold), threshold)


def similar_families(
    probes: DataFrame, candidates: DataFrame, threshold: float = config.JOIN_THRESHOLD, long_list: int = LONG_LIST
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """As `similar_classes`, without comparing the families of a long list: (pairs, members, asked).

    A key is one token at first. Families of a key that at most `long_list` of them have in a time block are compared. The others go on with keys that
    have one more token, up to the position where the next shared token of a similar pair must lie; only pairs that share it as well meet again. So families
    that have one very common token in common and nothing else are never compared. Sizes for which the tokens of a key are enough for the threshold
    need no comparison either: all families of that key and size are one group, and a pair that shares more meets again on
    a longer key, with a higher similarity. At the number of tokens that a pair shares, either list or group gives its exact value.

    `members`: class_key, group. `asked`: probe_class, probe_block, group, is_stored, similarity. Both None if no list is long.
    """
    left, right = (checkpoint(side) for side in _sides(probes, candidates, threshold))
    pairs, members, asked, level = [], [], [], 1
    while True:
        lists = left.select("key", "block", F.lit(1).alias("p"), F.lit(0).alias("c")).union(right.select("key", "block", F.lit(0), F.lit(1)))
        long = lists.groupBy("key", "block").agg(F.sum("p").alias("p"), F.sum("c").alias("c")).where((F.greatest("p", "c") > long_list) & (F.least("p", "c") > 0))
        long = checkpoint(long.select("key", "block"))
        if long.isEmpty():
            pairs.append(_compared(left, right, threshold))
            break
        short = lambda side: side.join(long, ["key", "block"], "left_anti")
        pairs.append(checkpoint(_compared(short(left), short(right), threshold)))
        left, right = (side.join(long, ["key", "block"], "left_semi") for side in (left, right))

        group = F.sha2(F.concat_ws(_SEP, F.lit(str(level)), F.col("n").cast("string"), "key"), 256).alias("group")
        enough = F.col("n") * threshold <= level + 1e-9
        grouped = right.where(enough).select("class_key", "key", "block", "is_stored", "n", group)
        members.append(checkpoint(grouped.select("class_key", "group").distinct()))
        sizes = grouped.select("key", "block", "is_stored", "n", "group").distinct()
        asking = left.where(F.col("probe_n") * threshold <= level + 1e-9).join(sizes, ["key", "block"]).where(
            _overlap_needed(F.col("probe_n"), F.col("n"), threshold) <= level
        ).where(F.col("is_stored") | (F.col("block") <= F.col("probe_block")))
        similarity = F.lit(level) / (F.col("probe_n") + F.col("n") - level)
        asked.append(checkpoint(asking.select("probe_class", "probe_block", "group", "is_stored", similarity.alias("similarity")).distinct()))

        level += 1
        left = checkpoint(_longer(left, "probe_n", "probe_tokens", "probe_pos", level, threshold))
        right = checkpoint(_longer(right, "n", "tokens", "pos", level, threshold))
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return union(pairs).distinct(), union(members), union(asked)


def _longer(side: DataFrame, n: str, tokens: str, pos: str, level: int, threshold: float) -> DataFrame:
    """Every row once per next token of its key, as far as the last of `level` shared tokens of a similar pair can lie."""
    end = F.least(F.size(tokens), F.size(tokens) - F.ceil(F.col(n) * threshold - 1e-9) + level)
    places = F.when(F.col(pos) + 1 < end, F.sequence(F.col(pos) + 1, (end - 1).cast("int")))
    grown = side.withColumn("next", F.explode(places))
    return grown.withColumn("key", F.concat_ws(_SEP, "key", F.get(tokens, F.col("next")))).withColumn(pos, F.col("next")).drop("next")


def best_parents(
    new_articles: DataFrame,
    recent: DataFrame | None = None,
    window_hours: int = config.STORY_WINDOW_HOURS,
    threshold: float = config.JOIN_THRESHOLD,
) -> DataFrame:
    """The most similar earlier article of each new article: article_id, parent_id,
    parent_is_stored, similarity. Articles without one are left out.

    `new_articles` and `recent` have article_id, title, at. Earlier means: any recent (stored)
    article, or a new one before it by (at, article_id). Both must lie within the window, whose
    border belongs to it. Equal similarity: stored first, then by (at, article_id).
    """
    pool = new_articles.select("article_id", "title", "at", F.lit(False).alias("is_stored"))
    if recent is not None:
        pool = pool.unionByName(recent.select("article_id", "title", "at", F.lit(True).alias("is_stored")))
    window_seconds = window_hours * 3600
    pool = with_shingles(pool).select(
        F.col("article_id").alias("id"), "at", "is_stored", "shingles", "set_key",
        F.floor(F.unix_seconds("at") / window_seconds).alias("block"),
        numbers.hours_before(F.col("at"), window_hours).alias("since"),
    )
    # Tables that several of the following joins read are computed once and cut from their plan.
    pool = checkpoint(pool)
    probes = pool.where("NOT is_stored")

    until = numbers.hours_after(F.col("at"), window_hours)
    earlier = (F.col("is_stored_hit") & (F.col("hit_at") <= until)) | (
        ~F.col("is_stored_hit")
        & ((F.col("hit_at") < F.col("at")) | ((F.col("hit_at") == F.col("at")) & (F.col("hit_id") < F.col("id"))))
    )

    def hits(members: DataFrame, asked: DataFrame, key: str) -> DataFrame:
        """The best earlier hit of each asking article; asked: id, at, since, key, is_stored, similarity."""
        found = first_at_or_after(members.select(key, "is_stored", "at", "id"), asked, [key, "is_stored"])
        hit = F.struct(
            (-F.col("similarity")).alias("distance"), (~F.col("is_stored_hit")).alias("is_new"), "hit_at", "hit_id"
        )
        return (
            asked.join(found, [key, "is_stored", "since"])
            .withColumnRenamed("is_stored", "is_stored_hit")
            .where(earlier)
            .groupBy("id")
            .agg(F.min(hit).alias("hit"))
        )

    flags = [False] if recent is None else [False, True]
    both = F.explode(F.array(*[F.lit(f) for f in flags])).alias("is_stored")
    exact = probes.select("id", "at", "since", "set_key", both, F.lit(1.0).alias("similarity"))
    copies = checkpoint(hits(pool, exact, "set_key"))

    classes = checkpoint(shingle_classes(pool.select("set_key", "shingles").dropDuplicates(["set_key"]), threshold))
    slim = pool.drop("shingles").join(copies.select("id", F.lit(True).alias("settled")), "id", "left")

    def near_hits(grouped: DataFrame, families: bool) -> DataFrame:
        """Best hits through one grouping of the sets; articles with an earlier copy do not ask."""
        tokens_of = grouped.select("class_key", "n", "tokens", "rare").dropDuplicates(["class_key"])
        members = slim.join(grouped.select("set_key", "class_key"), "set_key")
        probing = members.where("NOT is_stored AND settled IS NULL")
        sides = (
            probing.select("class_key", "block").distinct().join(tokens_of, "class_key"),
            members.select("class_key", "block", "is_stored").distinct().join(tokens_of, "class_key"),
        )
        matches, group_members, group_asked = similar_families(*sides, threshold) if families else (similar_classes(*sides, threshold), None, None)
        articles = probing.select("id", "at", "since", F.col("class_key").alias("probe_class"), F.col("block").alias("probe_block"))

        def through(found: DataFrame, of: DataFrame, key: str) -> DataFrame:
            asked = articles.join(found, ["probe_class", "probe_block"]).select("id", "at", "since", key, "is_stored", "similarity")
            return hits(of, checkpoint(asked), key)

        near = through(matches, members, "class_key")
        if group_members is None:
            return near
        return near.unionByName(through(group_asked, members.join(group_members, "class_key"), "group"))

    near = near_hits(classes, families=False)
    families = shingle_families(classes, threshold)
    if not families.isEmpty():
        near = near.unionByName(near_hits(families, families=True)).groupBy("id").agg(F.min("hit").alias("hit"))
    return copies.unionByName(near).select(
        F.col("id").alias("article_id"),
        F.col("hit.hit_id").alias("parent_id"),
        (~F.col("hit.is_new")).alias("parent_is_stored"),
        (-F.col("hit.distance")).alias("similarity"),
    )


def chain_roots(parents: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Follows parent links to their ends: article_id, root_id, root_is_stored.

    `parents` should be a stored or checkpointed table. Pointer jumping: every round doubles the length of the links, so the rounds grow with the
    logarithm of the longest chain. Each round is checkpointed. Links to a stored root are settled; all others are joined again.
    """
    links = parents.select(
        "article_id", F.col("parent_id").alias("root_id"), F.col("parent_is_stored").alias("root_is_stored")
    )
    for _ in range(max_rounds):
        step = links.select(
            F.col("article_id").alias("root_id"),
            F.col("root_id").alias("next_id"),
            F.col("root_is_stored").alias("next_is_stored"),
        )
        open_links = links.where("NOT root_is_stored").join(step, "root_id", "left")
        jumped = links.where("root_is_stored").withColumn("moved", F.lit(False)).unionByName(
            open_links.select(
                "article_id",
                F.coalesce("next_id", "root_id").alias("root_id"),
                F.coalesce("next_is_stored", "root_is_stored").alias("root_is_stored"),
                F.col("next_id").isNotNull().alias("moved"),
            )
        )
        jumped = checkpoint(jumped)
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return links
    raise RuntimeError("story chains did not settle")


def assign_stories(
    new_articles: DataFrame,
    recent: DataFrame | None = None,
    window_hours: int = config.STORY_WINDOW_HOURS,
    threshold: float = config.JOIN_THRESHOLD,
) -> DataFrame:
    """The story of each new article: article_id, story_id, is_new_story, similarity.

    `recent` has article_id, story_id, title, at. A new story takes its first article's id as its
    own id. Similarity is rounded to three decimals and is 1 for the article that starts a story.
    """
    parents = checkpoint(best_parents(new_articles, recent, window_hours, threshold))
    roots = chain_roots(parents)
    id_type = new_articles.schema["article_id"].dataType
    if recent is None:
        storied = roots.withColumn("story_id", F.col("root_id").cast("string"))
    else:
        stored = recent.select(F.col("article_id").alias("root_id"), F.col("story_id").alias("stored_story"))
        storied = roots.join(stored, "root_id", "left").withColumn(
            "story_id",
            F.when(F.col("root_is_stored"), F.col("stored_story")).otherwise(F.col("root_id").cast("string")),
        )
    joined = storied.join(parents.select("article_id", "similarity"), "article_id")
    return (
        new_articles.select(F.col("article_id").cast(id_type))
        .join(joined.select("article_id", "story_id", "similarity"), "article_id", "left")
        .select(
            "article_id",
            F.coalesce("story_id", F.col("article_id").cast("string")).alias("story_id"),
            F.col("story_id").isNull().alias("is_new_story"),
            F.coalesce(numbers.round3(F.col("similarity")), F.lit(1.0)).alias("similarity"),
        )
    )


def recent_pool(articles: DataFrame, as_of, hours: int = config.STORY_POOL_HOURS) -> DataFrame:
    """Stored articles that can still take new members: with a story, fetched recently."""
    since = numbers.hours_before(numbers.instant(as_of), hours)
    return articles.where(F.col("story_id").isNotNull() & (F.col("fetched_at") >= since)).select(
        "article_id", "story_id", "title", numbers.event_time().alias("at")
    )


def new_story_rows(assignments: DataFrame, articles: DataFrame) -> DataFrame:
    """First version of each new story, from the article that started it."""
    return (
        assignments.where("is_new_story")
        .join(articles, "article_id")
        .select(
            "story_id" if "story_id" not in articles.columns else assignments["story_id"],
            F.col("title").alias("headline"),
            F.col("at").alias("first_seen_at"),
            F.col("at").alias("last_seen_at"),
            F.lit(1).cast("long").alias("article_count"),
            F.lit(1).cast("long").alias("source_count"),
        )
    )


def refresh_stories(articles: DataFrame, story_ids: DataFrame | None = None) -> DataFrame:
    """Counts and time range of stories from their articles; all stories, or those given."""
    members = articles.where(F.col("story_id").isNotNull())
    if story_ids is not None:
        members = members.join(story_ids.select("story_id").distinct(), "story_id", "left_semi")
    return members.groupBy("story_id").agg(
        F.count("*").alias("article_count"),
        F.countDistinct("source_id").alias("source_count"),
        F.min(numbers.event_time()).alias("first_seen_at"),
        F.max(numbers.event_time()).alias("last_seen_at"),
    )


def update_stories(stored: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Stored story rows with refreshed counts; stories without articles keep theirs."""
    fresh = ["article_count", "source_count", "first_seen_at", "last_seen_at"]
    renamed = refreshed.select("story_id", *[F.col(c).alias(f"new_{c}") for c in fresh])
    kept = [c for c in stored.columns if c not in fresh]
    return stored.join(renamed, "story_id", "left").select(
        *kept, *[F.coalesce(f"new_{c}", c).alias(c) for c in fresh]
    )


def ingest_counters(inserted: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: new articles, new stories that kept an article, and articles that joined one.

    `inserted` are the articles that were really stored (article_id).
    """
    stored = assignments.join(inserted.select("article_id"), "article_id", "left_semi")
    # A new story carries the id of its first article, so it counts once any member was stored.
    new_stories = assignments.where("is_new_story").select("story_id")
    live = stored.select("story_id").distinct().join(new_stories, "story_id", "left_semi")
    return (
        stored.select(F.lit(1).alias("article"), F.lit(0).alias("story"))
        .unionByName(live.select(F.lit(0).alias("article"), F.lit(1).alias("story")))
        .agg(
            F.coalesce(F.sum("article"), F.lit(0)).alias("articles_new"),
            F.coalesce(F.sum("story"), F.lit(0)).alias("stories_new"),
        )
        .withColumn("stories_joined", F.col("articles_new") - F.col("stories_new"))
    )
