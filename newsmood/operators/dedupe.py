"""Deduplication on a key, inside a batch and against stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per key, the first by `order`.

    `row_number() = 1` is planned with a partial group limit, so every map task already drops all
    but its first row of a key: a key that holds a third of the batch crosses the shuffle as one
    row per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("_position", position).where("_position = 1").drop("_position")


def unseen(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    return batch.join(stored.select(*keys), list(keys), "left_anti")
