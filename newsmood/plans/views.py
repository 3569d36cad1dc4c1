"""The test tables mapped to the library's tables, as lazy DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.functions import numbers, text, urls
from newsmood.operators import detect, stories
from newsmood.session import checkpoint, utc

AS_OF = "2024-01-31 00:00:00"
ITEM_BASE = "2024-01-30 12:00:00"
ASSET_TYPES = ["central_bank", "currency_pair", "commodity", "index", "stock"]
ALIASES = [
    ("a01", "thanedble", False), ("a01", "attion to", False), ("a02", "thtion", False), ("a03", "Eriner", True),
    ("a04", "thing", False), ("a05", "thble", False), ("a06", "erre", False), ("a07", "ernd", False),
    ("a07", "ered", False), ("a08", "the anea", False), ("a09", "Thnt", True), ("a10", "zzunknown", False),
]
TEXT_TABLES = ("documents", "pages")
CLASSES = ["bullish", "bearish", "hawkish", "dovish", "neutral", "unclear"]


def asset(n: Column) -> Column:
    """a01..a10 from a number."""
    return F.concat(F.lit("a"), F.lpad((n % 10 + 1).cast("string"), 2, "0"))


def stamp(c: Column | str) -> Column:
    """A timestamp as text, for results that two engines compare."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Views:
    """Lazy mapped tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = utc(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
            # One small file is one task; work on its texts is dealt to all cores.
            df = df.repartition(cores)
        naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    # ---- news ------------------------------------------------------------------------------
    @cached_property
    def sources(self) -> DataFrame:
        n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
        sid = F.col("source")
        return (
            self.table("documents").select("source").distinct().select(
                sid.alias("source_id"),
                F.concat(F.lit("Source "), n.cast("string")).alias("name"),
                F.concat(F.when(n % 10 == 3, "http").otherwise("https"), F.lit("://feeds.example/"), sid).alias("feed_url"),
                F.concat(sid, F.lit(".example")).alias("site_domain"),
                F.element_at(F.array(*[F.lit(x) for x in ("central_bank", "news", "markets", "blog")]), n % 4 + 1).alias("kind"),
                (n % 7 != 0).alias("is_active"),
                F.concat(F.lit("e"), n.cast("string")).alias("etag"),
                F.concat(F.lit("m"), n.cast("string")).alias("last_modified"),
                F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-30 10:00:00")) + n * 60).alias("last_fetched_at"),
                F.lit("200").alias("last_status"),
                (n % 6).alias("consecutive_failures"),
            )
        )

    @cached_property
    def articles(self) -> DataFrame:
        base = F.timestamp_seconds(F.unix_timestamp(F.lit(ITEM_BASE)) - (F.col("doc_id") % 2016) * 300)
        url = F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))
        return self.table("documents").select(
            F.col("doc_id").alias("article_id"),
            # German articles come from sources that are not registered.
            F.when(F.col("lang") == "de", F.concat(F.lit("x-"), "source")).otherwise(F.col("source")).alias("source_id"),
            url.alias("url"),
            urls.url_hash(url).alias("url_hash"),
            text.collapse(F.regexp_extract("text", r"^[^\n.]*", 0)).alias("title"),
            text.collapse(F.col("text")).alias("excerpt"),
            text.collapse(F.col("text")).alias("body"),
            F.when(F.col("doc_id") % 10 != 0, base).alias("published_at"),
            (base + F.expr("INTERVAL 30 MINUTES")).alias("fetched_at"),
            F.when(F.col("n_chars") % 7 != 0, F.concat(F.lit("st"), (F.col("n_chars") % 97).cast("string"))).alias("story_id"),
            F.col("lang").alias("language"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        rows = [
            (f"a{n:02d}", f"a{n:02d}", f"Asset {n:02d}", ASSET_TYPES[n % 5], f"about {ASSET_TYPES[n % 5]}")
            for n in range(1, 11)
        ]
        return self.spark.createDataFrame(rows, "asset_id string, slug string, name string, asset_type string, description_simple string")

    @cached_property
    def aliases(self) -> DataFrame:
        return self.spark.createDataFrame(ALIASES, "asset_id string, alias string, is_case_sensitive boolean")

    @cached_property
    def stories(self) -> DataFrame:
        heads = self.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(
            F.min_by("title", F.struct(numbers.event_time(), "article_id")).alias("headline")
        )
        return heads.join(stories.refresh_stories(self.articles), "story_id")

    @cached_property
    def mentions(self) -> DataFrame:
        """Detection runs once per set of views; stored tables take its place in production."""
        return checkpoint(detect.mention_rows(self.articles, self.aliases))

    @cached_property
    def mention_signals(self) -> DataFrame:
        """Signals for the mentions whose article has a quality label."""
        n = F.substring("asset_id", 2, 2).cast("int")
        kind = F.when(F.col("toxic") == 1, 5).otherwise((F.col("article_id") + n) % 6)
        bank = n % 5 == 0
        up, down = F.when(bank, "hawkish").otherwise("bullish"), F.when(bank, "dovish").otherwise("bearish")
        times = self.articles.select("article_id", "fetched_at")
        return (
            self.mentions.join(self.table("labels").withColumnRenamed("doc_id", "article_id"), "article_id")
            .join(times, "article_id")
            .withColumn("kind", kind)
            .select(
                "article_id",
                "asset_id",
                F.when(F.col("kind") == 0, "neutral").when(F.col("kind").isin(1, 5), "unclear")
                .when(F.col("kind").isin(2, 3), up).otherwise(down).alias("stance"),
                F.when(F.col("kind") == 5, 0).otherwise((F.col("article_id") + n * 7) % 4).cast("int").alias("strength"),
                F.when(F.col("kind") == 5, F.array().cast("array<string>"))
                .otherwise(F.array(F.get("sentences", F.lit(0))["id"])).alias("evidence_ids"),
                F.concat(F.lit("w"), F.col("kind").cast("string")).alias("why"),
                F.when(F.col("kind") == 5, "failed").when(F.col("kind") == 1, "unclear").otherwise("ok").alias("status"),
                F.timestamp_seconds(F.unix_seconds("fetched_at") + n * 60).alias("created_at"),
            )
        )

    @cached_property
    def timed_mention_signals(self) -> DataFrame:
        times = self.articles.select("article_id", "fetched_at", numbers.event_time().alias("event_at"))
        return self.mention_signals.join(times, "article_id")

    # ---- signals ---------------------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    @cached_property
    def signals(self) -> DataFrame:
        bank = (F.col("user_id") % 10 + 1).isin(5, 10)
        failed = (F.col("event_type") == "signup") & (F.col("value") < 20)
        unclear = F.col("event_type") == "click"
        stance = (
            F.when(unclear | failed, "unclear").when(F.col("event_type") == "view", "neutral")
            .when(F.col("event_type") == "error", F.when(bank, "dovish").otherwise("bearish"))
            .otherwise(F.when(bank, "hawkish").otherwise("bullish"))
        )
        return self.events.select(
            F.col("event_id").alias("article_id"),
            asset(F.col("user_id")).alias("asset_id"),
            F.concat(F.lit("src"), (F.col("k") % 6).cast("string")).alias("source_id"),
            F.when(F.col("k") % 5 != 0, F.concat(F.lit("st"), (F.col("k") % 8).cast("string"))).alias("story_id"),
            stance.alias("stance"),
            (F.floor("value") % 4).cast("int").alias("strength"),
            F.when(failed, "failed").when(unclear, "unclear").otherwise("ok").alias("status"),
            F.col("ts").alias("event_at"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("fetched_at"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Gold and predicted labels with citations, one row per event."""
        gold = (
            F.when(F.col("event_type") == "click", "unclear").when(F.col("event_type") == "view", "neutral")
            .when(F.col("event_type") == "error", "bearish").when(F.col("event_type") == "signup", "bullish")
            .otherwise("hawkish")
        )
        v = F.floor("value").cast("long")
        sid = lambda c: F.concat(F.lit("S"), c.cast("string"))
        pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
        pred = pick([*CLASSES, "skipped", "validation_failed"], v % 8)
        return self.events.select(
            F.col("event_id").alias("example_id"),
            gold.alias("gold"),
            pred.alias("pred"),
            pick(["standard", "multi_asset", "not_in_title"], F.col("k") % 3).alias("bucket"),
            pick(ASSET_TYPES, F.col("user_id") % 5).alias("asset_type"),
            F.concat(F.lit("src"), (F.col("k") % 6).cast("string")).alias("source"),
            F.when(v % 8 != 6, F.when(v % 8 == 7, "failed").when(v % 8 == 5, "unclear").otherwise("ok")).alias("status"),
            F.array(sid(F.col("k") % 6 + 1), sid(v % 6 + 1)).alias("evidence_ids"),
            F.when(F.col("k") % 4 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(sid((F.col("k") + 1) % 6 + 1))).alias("gold_ids"),
            F.when(v % 8 != 6, F.col("k") % 9 != 0).alias("first_attempt_ok"),
            pick(["supports", "partial", "does_not_support"], v % 3).alias("verdict"),
            (v * 10).alias("latency_ms"),
            F.when(F.col("k") % 3 == 0, "author").otherwise(F.concat(F.lit("rater"), (F.col("k") % 3).cast("string"))).alias("labelled_by"),
        )

    # ---- prices ----------------------------------------------------------------------------
    @cached_property
    def prices(self) -> DataFrame:
        shift = F.datediff(F.lit("2024-01-30").cast("date"), F.lit("2001-08-01").cast("date"))
        return (
            self.table("orders")
            .select(
                asset(F.col("o_custkey")).alias("asset_id"),
                F.date_add(F.to_date("o_orderdate"), shift).alias("day"),
                "o_orderkey", "o_totalprice",
            )
            .groupBy("asset_id", "day")
            .agg(
                F.min_by("o_totalprice", "o_orderkey").alias("open"),
                F.max("o_totalprice").alias("high"),
                F.min("o_totalprice").alias("low"),
                F.max_by("o_totalprice", "o_orderkey").alias("close"),
            )
        )

    @cached_property
    def raw_candles(self) -> DataFrame:
        """Text fields; discounts above the tax give high < low, returns give text that is no number."""
        price = F.col("l_extendedprice")
        as_text = lambda c: c.cast("string")
        return self.table("lineitem").select(
            F.concat(F.lit("SYM"), (F.col("l_suppkey") % 12).cast("string")).alias("symbol"),
            (F.unix_seconds("l_shipdate") + (F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 86400).cast("string").alias("epoch"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "n/a").otherwise(as_text(price)).alias("open"),
            as_text(price * 2 * (1 + F.col("l_tax"))).alias("high"),
            as_text(price * 2 * (1 + F.col("l_discount") / 2)).alias("low"),
            F.when(F.col("l_quantity") == 1, "0").otherwise(as_text(price)).alias("close"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        rows = [(f"SYM{i}", f"a{i + 1:02d}") for i in range(10)]
        return self.spark.createDataFrame(rows, "symbol string, asset_id string")

    # ---- operations ------------------------------------------------------------------------
    @cached_property
    def calls(self) -> DataFrame:
        statuses = F.array(*[F.lit(x) for x in ("ok", "schema_retry", "failed", "timeout", "rate_limited")])
        return self.table("lineitem").select(
            F.when(F.col("l_linestatus") == "F", "stance").otherwise("brief").alias("stage"),
            F.col("l_returnflag").alias("model"),
            F.element_at(statuses, F.col("l_linenumber") % 5 + 1).alias("status"),
            F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("int")).alias("input_tokens"),
            (F.col("l_partkey") % 97).cast("int").alias("output_tokens"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def fetches(self) -> DataFrame:
        outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "not_modified").otherwise("ok")
        return self.events.select(
            F.concat(F.lit("src"), (F.col("k") % 20).cast("string")).alias("source_id"),
            F.col("event_id").alias("fetch_id"), F.col("ts").alias("fetched_at"), outcome.alias("outcome"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """The last fetch of every source."""
        latest = F.struct("fetched_at", "fetch_id")
        last = self.fetches.groupBy("source_id").agg(
            F.max_by("outcome", latest).alias("outcome"), F.max_by("fetch_id", latest).alias("fetch_id")
        )
        return last.select(
            "source_id", "outcome",
            F.when(F.col("outcome") == "error", "http_500").when(F.col("outcome") == "ok", "200").otherwise("304").alias("status"),
            F.when(F.col("fetch_id") % 2 == 0, F.concat(F.lit("new-"), F.col("fetch_id").cast("string"))).alias("etag"),
            F.lit(None).cast("string").alias("last_modified"),
        )

    @cached_property
    def feed_items(self) -> DataFrame:
        """Raw items from web pages, with ISO and RFC 822 dates in turn."""
        moment = F.timestamp_seconds(F.unix_timestamp(F.lit(ITEM_BASE)) - (F.col("page_id") % 10) * 86400)
        return self.table("pages").select(
            F.col("page_id"),
            F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("feed"),
            F.regexp_extract("html", r"(?i)<title>([\s\S]*?)</title>", 1).alias("title"),
            F.col("url").alias("link"),
            F.col("html").alias("summary"),
            F.when(F.col("page_id") % 2 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .otherwise(F.concat(F.date_format(moment, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("date"),
            moment.alias("item_at"),
        )

    # ---- users -----------------------------------------------------------------------------
    @cached_property
    def watchlists(self) -> DataFrame:
        return (
            self.table("orders").select(F.col("o_custkey").alias("user_id"), asset(F.col("o_orderkey")).alias("asset_id"), "o_orderdate")
            .groupBy("user_id", "asset_id").agg(F.min("o_orderdate").alias("added_at"))
        )

    @cached_property
    def requested(self) -> DataFrame:
        orders = self.table("orders")
        slugs = orders.select(F.col("o_custkey").alias("user_id"), asset(F.col("o_orderkey") * 3).alias("slug"))
        urgent = orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 490000")
        unknown = urgent.select(F.col("o_custkey").alias("user_id"), F.lit("zz-unknown").alias("slug"))
        odd = orders.where("o_orderpriority = '5-LOW' AND o_totalprice > 490000").select(
            F.col("o_custkey").alias("user_id"), F.lit("NOT A SLUG").alias("slug")
        )
        return slugs.unionByName(unknown).unionByName(odd).distinct()

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 5000).alias("beginner_mode"),
            F.when(F.col("c_acctbal") > 5000, "beginner").otherwise("standard").alias("level"),
        )

    @cached_property
    def briefs_log(self) -> DataFrame:
        """Briefs created by each user; those of open and filled orders are from today."""
        today = F.unix_timestamp(F.lit(AS_OF))
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.timestamp_seconds(
                today + F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 86400).otherwise(-1 - F.col("o_orderkey") % 86400)
            ).alias("created_at"),
        )

    @cached_property
    def bullets(self) -> DataFrame:
        body = (
            F.when(F.col("event_type") == "click", " Stocks fell in a sell-off. ")
            .when(F.col("event_type") == "view", "You should wait, then BUY.")
            .when(F.col("event_type") == "error", "Investors SELL gold.")
            .when(F.col("event_type") == "signup", "Analysts raised the price  target.")
            .otherwise("Selling slowed; buybacks rose.")
        )
        art = lambda c: F.concat(F.lit("art"), c.cast("string"))
        return self.events.select(
            "user_id", F.col("event_id").alias("bullet_no"), body.alias("text"),
            F.array(asset(F.col("k")), asset(F.col("k") + F.col("user_id"))).alias("asset_slugs"),
            F.array(art(F.col("k") % 7), art(F.floor("value").cast("long") % 9)).alias("article_ids"),
        )

    @cached_property
    def offered_articles(self) -> DataFrame:
        return self.events.select("user_id", F.concat(F.lit("art"), (F.col("k") % 8).cast("string")).alias("article_id")).distinct()

    @cached_property
    def part_records(self) -> DataFrame:
        """Nested catalogue records from parts: every word of the name and the brand are aliases."""
        key = F.col("p_partkey")
        slug = F.concat(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "-")), F.lit("-"), key.cast("string"))
        words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("alias"), F.lit(False).alias("is_case_sensitive")))
        brand = F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_brand").alias("alias"), F.lit(True).alias("is_case_sensitive")))).otherwise(
            F.array().cast("array<struct<alias:string,is_case_sensitive:boolean>>")
        )
        types = F.create_map(*[F.lit(x) for pair in PART_TYPES.items() for x in pair])
        return self.table("part").select(
            F.concat(F.lit("p"), key.cast("string")).alias("asset_id"), slug.alias("slug"), F.col("p_name").alias("name"),
            F.try_element_at(types, F.col("p_type")).alias("asset_type"), F.col("p_brand").alias("description_simple"),
            F.array_distinct(F.concat(words, brand)).alias("aliases"),
        )


PART_TYPES = {
    "ECONOMY": "commodity", "LARGE": "stock", "MEDIUM": "index", "PROMO": "crypto", "SMALL": "currency_pair",
    "STANDARD": "central_bank",
}
