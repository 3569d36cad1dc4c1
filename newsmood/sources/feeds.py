"""Landed feed files (RSS and Atom) as rows of raw items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = ("title", "description", "content:encoded", "summary", "content", "pubDate", "dc:date", "published", "updated")
_LINK = T.StructType([T.StructField(name, T.StringType()) for name in ("_VALUE", "_href", "_rel")])
#: Fields of an RSS item and of an Atom entry.
_ITEM = T.StructType([*[T.StructField(name, T.StringType()) for name in _TEXTS], T.StructField("link", T.ArrayType(_LINK))])
#: Items and entries of a file; what a CDATA section holds is not looked at.
_ITEMS = r"(?s)<(item|entry)(?:\s[^>]*)?>(?:<!\[CDATA\[.*?\]\]>|[^<]++|<(?!/\1>))*+</\1>"


def _text(*candidates: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in candidates])


def _items(files: DataFrame) -> DataFrame:
    """feed_file, title, link, summary, date of every item or entry of whole files (`value`), and the files' folder columns.

    The link of an entry is its alternate link, or the first one. The summary is the first text that is not empty: description or content if it holds more than
    tags, then summary, then the others. The date prefers the ISO form. An item that is no XML is left out.
    """
    folders = [c for c in files.columns if c not in ("value", "feed_file")]
    parsed = files.select("feed_file", *folders, F.explode(F.regexp_extract_all("value", F.lit(_ITEMS), F.lit(0))).alias("xml")).select(
        "feed_file", *folders, F.from_xml("xml", _ITEM).alias("i"))
    links = F.col("i.link")
    href = F.filter(links, lambda k: k["_href"].isNotNull())
    alternate = F.get(F.filter(href, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    plain = F.get(F.filter(links, lambda k: k["_VALUE"].isNotNull()), F.lit(0))["_VALUE"]
    shown = lambda name: F.when(F.trim(F.regexp_replace(f"i.`{name}`", "<[^>]*>", "")) != "", F.col(f"i.`{name}`"))
    return parsed.where(F.coalesce(*[F.col(f"i.`{name}`") for name in _TEXTS], plain, alternate).isNotNull()).select(
        "feed_file", *folders,
        F.col("i.title").alias("title"),
        F.coalesce(plain, alternate, F.get(href, F.lit(0))["_href"]).alias("link"),
        F.coalesce(shown("description"), shown("content"), _text(*[F.col(f"i.`{n}`") for n in ("summary", "description", "content", "content:encoded")])).alias("summary"),
        F.coalesce("i.published", "i.updated", "i.`dc:date`", "i.pubDate").alias("date"),
    )


def read_feeds(spark: SparkSession, path: str, folders: str = "") -> DataFrame:
    """Raw items of landed RSS and Atom files, which are read once. `folders`: columns of the folder names, as a schema text."""
    return _items(_whole(spark.read, folders).load(path).withColumn("feed_file", F.input_file_name()))


def stream_feeds(spark: SparkSession, path: str, files_per_batch: int | None = None, folders: str = "") -> DataFrame:
    """The same as a stream of newly landed files."""
    reader = _whole(spark.readStream, folders)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _items(reader.load(path).withColumn("feed_file", F.input_file_name()))


def _whole(reader, folders: str):
    return reader.format("text").option("wholetext", True).schema("value string" + (f", {folders}" if folders else ""))


def write_rss(items: DataFrame, path: str, *folders: str) -> None:
    """Items (title, link, description, pubDate) as RSS files, in one folder per value of the columns `folders`."""
    items.write.partitionBy(*folders).format("xml").option("rootTag", "rss").option("rowTag", "item").mode("append").save(path)


def write_atom(items: DataFrame, path: str, *folders: str) -> None:
    """Items (title, link, summary, content, published) as Atom files."""
    link = F.struct(F.lit("alternate").alias("_rel"), F.col("link").alias("_href"))
    items.withColumn("link", link).write.partitionBy(*folders).format("xml").option("rootTag", "feed").option("rowTag", "entry").mode("append").save(path)
