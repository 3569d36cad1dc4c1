"""Forward as-of lookup: the first member of a group at or after a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 600


def first_at_or_after(
    members: DataFrame, queries: DataFrame, group: list[str], slot_seconds: int = SLOT_SECONDS
) -> DataFrame:
    """For each (group, since) in `queries`, the earliest (at, id) member with at >= since.

    `members`: group columns, at, id. `queries`: group columns, since. Result: group columns,
    since, hit_at, hit_id; queries without a hit are left out.

    One task holds the members of a group in one slot, or one row per slot of a group. Members are first reduced to one row per (group, at) and
    queries to distinct (group, since), both with map-side combine. Time is then cut into slots:
    inside a slot a running window answers the query, and a query whose slot has no later member
    takes the first member of the next slot that has one, from a table with one row per slot.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (slot_seconds * 1_000_000))
    hits = members.groupBy(*group, "at").agg(F.min("id").alias("id"))
    hits = hits.select(*group, slot(F.col("at")).alias("slot"), F.struct("at", "id").alias("hit"))
    wanted = queries.select(*group, "since").distinct().withColumn("slot", slot(F.col("since")))

    empty = F.lit(None).cast(hits.schema["hit"].dataType)
    line = hits.select(*group, "slot", F.col("hit.at").alias("moment"), F.lit(1).alias("is_member"), "hit").unionByName(
        wanted.select(*group, "slot", F.col("since").alias("moment"), F.lit(0).alias("is_member"), empty.alias("hit"))
    )
    # Latest first, and a member before a query at the same time, so "last seen" is "next to come".
    inside = (
        Window.partitionBy(*group, "slot")
        .orderBy(F.desc("moment"), F.desc("is_member"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = (
        line.withColumn("near", F.last("hit", ignorenulls=True).over(inside))
        .where("is_member = 0")
        .select(*group, F.col("moment").alias("since"), "slot", "near")
    )

    # One row per (group, slot): its first member, and a marker where a query looks beyond it.
    per_slot = hits.groupBy(*group, "slot").agg(F.min("hit").alias("first_hit")).withColumn("is_member", F.lit(1))
    beyond = (
        wanted.select(*group, "slot").distinct().withColumns({"first_hit": empty, "is_member": F.lit(0)})
    )
    across = (
        Window.partitionBy(*group)
        .orderBy(F.desc("slot"), F.asc("is_member"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = (
        per_slot.unionByName(beyond)
        .withColumn("later", F.last("first_hit", ignorenulls=True).over(across))
        .where("is_member = 0")
        .select(*group, "slot", "later")
    )
    return (
        answered.join(later, [*group, "slot"], "left")
        .withColumn("hit", F.coalesce("near", "later"))
        .where("hit IS NOT NULL")
        .select(*group, "since", F.col("hit.at").alias("hit_at"), F.col("hit.id").alias("hit_id"))
    )
