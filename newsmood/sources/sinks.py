"""Sinks: insert-ignore, upsert, run ledger, evaluation results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from newsmood.operators.dedupe import first_per_key, unseen
from newsmood.session import checkpoint


def new_rows(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Insert-ignore: the batch's first row per key, unless the key is stored already."""
    return unseen(first_per_key(batch, keys, order), stored, keys)


def insert_ignore(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The table after an insert that keeps stored rows on conflict."""
    return stored.unionByName(new_rows(batch, stored, keys, order).select(*stored.columns))


def upsert(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The table after a write where the batch wins on conflict and other stored rows stay."""
    fresh = first_per_key(batch, keys, order).select(*stored.columns)
    return stored.join(fresh.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(fresh)


def column_names(ddl: str) -> list[str]:
    """Column names of a schema text whose columns are separated by a comma and a blank."""
    return [column.split()[0] for column in ddl.split(", ")]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stored table with the columns of `schema`, or an empty one before its first write."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(wanted).parquet(path).select(*wanted.names)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], wanted)


#: Folders that the keys of a keyed table are dealt into, and how many keys of a batch are sent to all tasks at once (some 100 bytes each).
KEY_BUCKETS = 64
BROADCAST_KEYS = 500_000
_BUCKET = "key_bucket"


def with_bucket(rows: DataFrame, keys: Sequence[str], buckets: int = KEY_BUCKETS) -> DataFrame:
    """Adds the folder of a row's key."""
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def key_slices(counts: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """Buckets in groups of at most `most` keys together; a bucket with more is a group of its own that is read in several parts."""
    slices: list[tuple[list[int], int]] = []
    open_slice, size = [], 0
    for bucket, n in sorted(counts.items(), key=lambda kv: (kv[1], kv[0])):
        if n > most:
            slices.append(([bucket], -(-n // most)))
        elif open_slice and size + n > most:
            slices.append((open_slice, 1))
            open_slice, size = [bucket], n
        else:
            open_slice, size = [*open_slice, bucket], size + n
    return slices + ([(open_slice, 1)] if open_slice else [])


def stored_keys(batch: DataFrame, stored: DataFrame, keys: Sequence[str], most: int = BROADCAST_KEYS) -> DataFrame:
    """The keys of `batch` that `stored` has. Both have their bucket; `batch` is a written or checkpointed table with one row per key.

    Only the folders of buckets that the batch touches are read, only their key columns, and the stored side is never shuffled: the
    keys of the batch go to it, at most `most` at a time. A large batch is cut by buckets, so each folder is read once.
    """
    # At most one row per bucket.
    counts = {r[_BUCKET]: r["count"] for r in batch.groupBy(_BUCKET).count().collect()}
    found = []
    for buckets, parts in key_slices(counts, most):
        inside = F.col(_BUCKET).isin(buckets)
        for part in range(parts):
            mine = batch.where(inside & (F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(parts)) == part)).select(*keys, _BUCKET)
            found.append(stored.where(inside).select(*keys, _BUCKET).join(F.broadcast(mine), [*keys, _BUCKET], "left_semi"))
    return reduce(DataFrame.union, found).select(*keys).distinct() if found else batch.select(*keys).limit(0)


def not_stored(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str],
               buckets: int = KEY_BUCKETS, most: int = BROADCAST_KEYS) -> DataFrame:
    """The batch's first row per key, with its bucket, unless the keyed table at `path` has the key; computed once.

    The cost follows the batch: its keys are looked up in the buckets they belong to, without moving stored rows.
    """
    fresh = checkpoint(with_bucket(first_per_key(batch, keys, order), keys, buckets))
    key_schema = T.StructType([*[batch.schema[k] for k in keys], T.StructField(_BUCKET, T.IntegerType())])
    known = stored_keys(fresh, read_table(batch.sparkSession, path, key_schema), keys, most)
    return checkpoint(fresh.join(known, list(keys), "left_anti").select(*fresh.columns))


def append_rows(rows: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), buckets: int = KEY_BUCKETS) -> None:
    """Appends rows to the folders of their buckets, without looking at stored ones."""
    placed = with_bucket(rows, keys, buckets)
    placed.repartition(_BUCKET, *partition_by).write.mode("append").partitionBy(_BUCKET, *partition_by).parquet(path)


def append_new(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str],
               partition_by: Sequence[str] = (), buckets: int = KEY_BUCKETS, most: int = BROADCAST_KEYS) -> None:
    """Insert-ignore into a keyed parquet table: only unseen keys are appended."""
    append_rows(not_stored(batch, path, keys, order, buckets, most), path, keys, partition_by, buckets)


def upsert_partitions(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str],
                      partition_by: str = "day") -> None:
    """Upsert into a parquet table, rewriting only the partitions the batch touches.

    Stored rows are read back only from those partitions, and dynamic partition overwrite replaces
    each of them when the job commits. The batch is read several times, so it is computed once.
    """
    batch = checkpoint(batch)
    stored = read_table(batch.sparkSession, path, batch.schema)
    touched = batch.select(partition_by).distinct()
    affected = stored.join(touched, partition_by, "left_semi")
    upsert(batch, affected, keys, order).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition_by).parquet(path)


RUN_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("finished_at", T.TimestampType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("stats", T.StringType(), False),
    ]
)


def run_row(counters: DataFrame, job: str, started_at: datetime | str, finished_at: datetime | str,
            status: str = "ok") -> DataFrame:
    """A ledger row from a one-row DataFrame of counters, which become a JSON object."""
    lit = lambda t: F.lit(t).cast("timestamp")
    return counters.select(
        F.lit(job).alias("job"),
        lit(started_at).alias("started_at"),
        lit(finished_at).alias("finished_at"),
        F.lit(status).alias("status"),
        F.to_json(F.struct(*counters.columns)).alias("stats"),
    )


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").parquet(path)


def write_results(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines: one summary record and the rows of all examples."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")
