"""Registered queries: name, the operators they cover, Spark plan, SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from newsmood.plans.oracle_views import compose
from newsmood.plans.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Views(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, needs: str = "", recursive: str = ""):
    """Registers the decorated plan under its function name.

    `covers` lists operator ids, `needs` the mapped views its SQL uses.
    """

    def register(plan: Callable[[Views], DataFrame]):
        text = compose(sql, needs.split(), recursive) if sql else None
        QUERIES[plan.__name__] = Query(plan.__name__, tuple(covers.split()), plan, text)
        return plan

    return register
