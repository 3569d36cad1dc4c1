"""The hand-labelled examples as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood import config


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields, doubled quotes, line breaks inside quotes and a byte-order mark are read;
    cells are trimmed, missing cells are '', rows without any text are dropped.

    Columns are taken by name from the header, in any order.
    """
    raw = spark.read.options(
        header=True, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    present = {c.strip(): c for c in raw.columns}
    cells = [
        F.coalesce(F.trim(F.col(f"`{present[c]}`")), F.lit("")).alias(c) if c in present else F.lit("").alias(c)
        for c in config.JUDGE_COLUMNS
    ]
    return raw.select(*cells).where(F.concat(*config.JUDGE_COLUMNS) != "")


def write_labels(rows: DataFrame, path: str) -> None:
    """The label columns as CSV files with a header; missing columns are empty."""
    cells = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
        for c in config.JUDGE_COLUMNS
    ]
    rows.select(*cells).write.mode("errorifexists").options(
        header=True, quote='"', escape='"', emptyValue="", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
