"""The asset catalogue: nested records to tables, and lookups on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.functions import numbers

def asset_rows(records: DataFrame) -> DataFrame:
    """One row per asset; the slug is the id unless the records bring their own."""
    key = "asset_id" if "asset_id" in records.columns else "slug"
    return records.select(F.col(key).alias("asset_id"), "slug", "name", "asset_type", "description_simple")


def alias_rows(records: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per alias, with the id its asset has in the stored table."""
    exploded = records.select("slug", F.explode("aliases").alias("a")).select("slug", "a.alias", "a.is_case_sensitive")
    return exploded.join(assets.select("asset_id", "slug"), "slug").select("asset_id", "alias", "is_case_sensitive")


def ordered_catalogue(assets: DataFrame) -> DataFrame:
    return assets.orderBy("asset_type", "name", "asset_id")


def asset_by_slug(assets: DataFrame, slug: str) -> DataFrame:
    return assets.where(F.col("slug") == slug)


def search_catalogue(assets: DataFrame, query: str) -> DataFrame:
    """Assets whose name, slug, description or type label contains the text, ignoring case.

    Rows stay one per asset with its type as the group; order by asset_type, name to show them.
    """
    haystack = F.lower(
        F.concat_ws(" ", "name", "slug", "description_simple", numbers.asset_type_label(F.col("asset_type")))
    )
    wanted = query.strip().lower()
    return assets.where(haystack.contains(wanted)) if wanted else assets


def search_group_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("asset_type").agg(F.count("*").alias("assets"))
