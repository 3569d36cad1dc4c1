"""Reproducible samples for labelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.operators.detect import compile_aliases
from newsmood.session import checkpoint


def seeded_order(seed: int, *key: Column | str) -> Column:
    """A position that depends only on the key and the seed: an MD5, which any SQL engine has."""
    return F.md5(F.concat_ws(":", *key, F.lit(str(seed))).cast("binary"))


def spot_check(rows: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """`n` rows in seeded order."""
    return rows.orderBy(seeded_order(seed, *key), *key).limit(n)


def example_id(article_id: Column, slug: Column) -> Column:
    """The slug and the whole digest of article and slug: it serves as a key, so nothing is cut off."""
    return F.concat(slug, F.lit("-"), F.sha1(F.concat(article_id.cast("string"), F.lit(":"), slug)))


def hard_cases(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Bucket of every mention: not_in_title, multi_asset (three or more assets), standard.

    The headline is sentence S1. An article has at most as many mentions as the catalogue has
    assets, so its mentions are counted by a window; the patterns of an asset are one short list.
    """
    patterns = compile_aliases(aliases).groupBy("asset_id").agg(F.collect_list("pattern").alias("patterns"))
    headline = F.get(F.filter("sentences", lambda s: s["id"] == "S1"), F.lit(0))["text"]
    in_title = F.exists("patterns", lambda p: F.coalesce(F.regexp(headline, p), F.lit(False)))
    assets = F.count("*").over(Window.partitionBy("article_id"))
    return (
        mentions.withColumn("assets", assets)
        .join(patterns, "asset_id", "left")
        .withColumn(
            "bucket",
            F.when(~F.coalesce(in_title, F.lit(False)), "not_in_title")
            .when(F.col("assets") >= config.HARD_ASSETS_PER_ARTICLE, "multi_asset")
            .otherwise("standard"),
        )
        .drop("assets", "patterns")
    )


def _levels(pool: DataFrame, counts: DataFrame, n: int, seed: int) -> DataFrame:
    """The first `n` picks of a pool when every pick goes to the asset with the fewest so far.

    The k-th pick of an asset happens at level (rows it already has) + k, and picks happen in the
    order of (level, asset order). Within an asset, the k-th candidates of all its sources come
    before the (k+1)-th. No asset can give more than `n` rows, so both ranks are group limits that
    map tasks apply before the shuffle.
    """
    in_source = F.row_number().over(
        Window.partitionBy("asset", "source").orderBy(seeded_order(seed, "key"), "key")
    )
    in_asset = F.row_number().over(
        Window.partitionBy("asset").orderBy("source_turn", seeded_order(seed, "asset", "source"), "source")
    )
    ranked = (
        pool.withColumn("source_turn", in_source).where(F.col("source_turn") <= n)
        .withColumn("asset_turn", in_asset).where(F.col("asset_turn") <= n)
    )
    return (
        ranked.join(counts, "asset", "left")
        .withColumn("level", F.coalesce("have", F.lit(0).cast("long")) + F.col("asset_turn"))
        .orderBy("level", seeded_order(seed, "asset"), "asset")
        .limit(n)
        .drop("source_turn", "asset_turn", "level", "have")
    )


def stratified_sample(
    candidates: DataFrame, n: int, seed: int, hard_share: float, existing: DataFrame | None = None
) -> DataFrame:
    """Picks `n` candidates (key, asset, source, hard), balanced over assets and sources.

    A quota of hard cases is filled first, then the others, then hard ones again if those run out.
    `existing` (asset, hard) are rows already in the file: they count towards balance and quota.
    Only the numbers of rows picked come back to the driver.
    """
    spark = candidates.sparkSession
    # Read by every stage; four short columns of each candidate.
    candidates = checkpoint(candidates.select("key", "asset", "source", "hard"))
    if existing is None:
        existing = spark.createDataFrame([], "asset string, hard boolean")
    have, have_hard = existing.agg(F.count("*"), F.count_if("hard")).first()
    quota = min(n, max(0, int((have + n) * hard_share + 0.5) - have_hard))

    columns = candidates.columns
    counts = existing.groupBy("asset").agg(F.count("*").alias("have"))
    empty = candidates.limit(0)

    def with_picks(picks: DataFrame) -> DataFrame:
        return counts.unionByName(picks.groupBy("asset").agg(F.count("*").alias("have"))).groupBy("asset").agg(
            F.sum("have").alias("have")
        )

    hard, easy = candidates.where("hard"), candidates.where("NOT hard")
    first = _levels(hard, counts, quota, seed).select(*columns) if quota else empty
    first = checkpoint(first) if quota else empty
    missing = n - first.count()
    second = _levels(easy, with_picks(first), missing, seed).select(*columns) if missing else empty
    second = checkpoint(second) if missing else empty
    picked = first.unionByName(second)
    missing = n - picked.count()
    if not missing:
        return picked
    rest = hard.join(first.select("key"), "key", "left_anti").select(*columns)
    return picked.unionByName(_levels(rest, with_picks(picked), missing, seed).select(*columns))
