"""A corpus from documents to packed sequences: the operators of `newsmood.llm` as stages.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsmood.llm import exact_dedup, mixing, packing, simhash_pivots, toxicity
from newsmood.llm.common import stage, table


#: Bytes of whole texts that go to a Python worker at once, on both sides of the pipe; batches of 10 000 rows would hold tens of MB of text several times.
BATCH_BYTES = 4 << 20


def _bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by their bytes as well, unless the session has a bound of its own; rows are the same."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not predicted toxic; the scorer learns from the labels of documents in `docs`."""
    _bounded_batches(spark)
    return toxicity.keep_rows(docs, table(spark, folder, "labels"))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of texts that share 0.8 or more of their five-word shingles, the row with the smallest id.

    SimHash fingerprints by tables of pivots, verified; then MinHash for pairs that lie outside the fingerprints' radius.
    """
    _bounded_batches(spark)
    return simhash_pivots.keep_rows(docs, shingle=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document at least once; those of small sources up to 1.5 times, towards even weights."""
    return mixing.mixed_rows(docs, target_entropy=1.0, max_repeats=1.5)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of at most 2048 ids in sequences; `row` tells a document's repeats apart."""
    import public_tokenizers

    _bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", pack)]

#: SQL cannot express the trained, iterative and packing stages; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, folder), name.replace(" ", "-"))
    return docs
