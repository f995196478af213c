"""Named queries: a DataFrame plan over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadgauge.session import pin_session

SECTIONS = (
    "snapshot", "text", "sampling", "answers", "cards", "estimates", "quality",
    "discussion", "ledger", "gates", "reports",
)


class Tables:
    """Parquet tables of one folder, read lazily by attribute, plus derived role tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin_session(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def role(self, name: str) -> DataFrame:
        from threadgauge.plans.roles import ROLES

        table, exprs = ROLES[name]
        return getattr(self, table).selectExpr(*exprs)


@dataclass(frozen=True)
class Plan:
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    def keep(fn):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(fn, sql)
        return fn

    return keep


def load() -> dict[str, Plan]:
    for section in SECTIONS:
        importlib.import_module(f"threadgauge.plans.{section}")
    return PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(p: Plan):
        return lambda spark, folder: p.build(Tables(spark, folder))

    return {name: runner(p) for name, p in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: p.sql for name, p in load().items() if p.sql}
