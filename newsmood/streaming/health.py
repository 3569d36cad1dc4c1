"""Source health as a stream of fetch outcomes; the state is a keyed table of sources.

The table is dealt into buckets by source. A batch reads and rewrites only the buckets of the sources that it has outcomes for. A row knows the last batch
that it took in, so a batch that comes again after a failure leaves the rows that it reached alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsmood import config
from newsmood.session import checkpoint
from newsmood.sources import sinks

STATE = "source_id string, is_active boolean, consecutive_failures long, upto long, source_bucket int"


def fold_batch(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """sources (source_id, is_active, consecutive_failures) after any number of outcomes per source, as if they came one by one.

    `outcomes`: source_id, fetched_at, fetch_id, outcome. A success starts a new run of errors; the errors before the first one add to the stored number. A source is
    switched off as soon as a run reaches the limit, and stays so. How outcomes are parted into batches does not matter.
    """
    so_far = Window.partitionBy("source_id").orderBy("fetched_at", "fetch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_error = F.col("outcome") == "error"
    runs = outcomes.withColumn("run", F.count_if(~is_error).over(so_far)).groupBy("source_id", "run").agg(F.count_if(is_error).alias("errors"))
    joined = sources.join(runs, "source_id", "left")
    length = F.col("errors") + F.when(F.col("run") == 0, F.col("consecutive_failures")).otherwise(0)
    reached = F.max((F.col("errors") > 0) & (length >= config.MAX_CONSECUTIVE_FAILURES))
    return joined.groupBy("source_id", "is_active", "consecutive_failures").agg(
        F.coalesce(reached, F.lit(False)).alias("reached"), F.max_by(length, "run").alias("last")
    ).select(
        "source_id", (F.col("is_active") & ~F.col("reached")).alias("is_active"),
        F.coalesce("last", "consecutive_failures").cast("long").alias("consecutive_failures"))


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_bucket", F.pmod(F.xxhash64("source_id"), F.lit(sinks.KEY_BUCKETS)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    rows.select(*sinks.column_names(STATE)).repartition("source_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_bucket").parquet(path)


def apply_batch(outcomes: DataFrame, path: str, number: int) -> None:
    """Folds one numbered batch of outcomes into the stored sources; outcomes of sources that are not stored have no effect."""
    outcomes = checkpoint(_in_buckets(outcomes))
    touched = [r["source_bucket"] for r in outcomes.select("source_bucket").distinct().collect()]
    stored = checkpoint(sinks.read_table(outcomes.sparkSession, path, STATE).where(F.col("source_bucket").isin(touched)))
    open_rows = stored.where((F.col("upto") < number) & F.col("source_id").isNotNull())
    new = outcomes.join(open_rows.select("source_id"), "source_id", "left_semi")
    folded = fold_batch(open_rows, new).withColumn("upto", F.lit(number).cast("long"))
    kept = stored.where(~((F.col("upto") < number) & F.col("source_id").isNotNull())).drop("source_bucket")
    _write(checkpoint(_in_buckets(folded.select(*kept.columns).union(kept))), path)


def start_health(outcomes: DataFrame, initial: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Folds landed outcomes into the table at `path`, which starts as the initial one."""
    first = initial.select("source_id", "is_active", F.col("consecutive_failures").cast("long"), F.lit(-1).cast("long").alias("upto"))
    _in_buckets(first).write.mode("ignore").partitionBy("source_bucket").parquet(path)
    return (
        outcomes.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, path, number))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def current_sources(spark: SparkSession, path: str) -> DataFrame:
    """source_id, is_active, consecutive_failures as of the last batch."""
    return sinks.read_table(spark, path, STATE).select("source_id", "is_active", "consecutive_failures")
