"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.session import scratch_path

#: Words of the query contracts: everything between ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables.

    Python workers are told where the driver found this library, so it need not be the folder they start in. On a cluster
    it has to be installed or shipped as usual. A table in fewer parts than there are cores (one small file) is dealt out anew,
    so that work per row uses all of them.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends, each row is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(text: Column) -> Column:
    """The text as stored; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def power_of_two(n: int) -> int:
    """The smallest power of two that is at least `n`."""
    return 1 << max(0, int(n) - 1).bit_length()


#: A group is large if it holds more than one in LARGE of all rows; so there are fewer than LARGE large groups.
LARGE = 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows` with one row per key in `groups`, where column `size` counts the rows of the key among `total`.

    Large groups are broadcast (fewer than LARGE rows), the others are shuffled: no key is hot in the shuffle.
    """
    large = F.col(size) * LARGE > total
    few = rows.join(F.broadcast(groups.where(large)), key)
    rest = rows.join(F.broadcast(groups.where(large).select(key)), key, "left_anti").join(groups.where(~large), key)
    return few.unionByName(rest)
