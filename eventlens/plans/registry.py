"""Named analysis plans: one per operator, each a (Spark builder, oracle SQL) pair.

A Spark builder takes (spark, sf_dir) and returns a lazy DataFrame over the
driver tables (or data Spark derives from them). The oracle SQL computes the
same result independently in DuckDB over the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..roles import Roles
from ..sources import fact_view, raw_view
from . import oracle as O

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    build: Builder
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        PLANS[name] = Plan(name, fn, sql)
        return fn
    return deco


# Role mappings over the fact view.
R = Roles(tie_break=("event_id",))
RS = R.with_(total="total_skewed")          # skewed measure (outliers, segments)
RG = R.with_(company="company_group")       # multi-country entity


def F(spark: SparkSession, d: str) -> DataFrame:
    return fact_view(spark, d)


def RAW(spark: SparkSession, d: str, unknown_group: int | None = None) -> DataFrame:
    return raw_view(spark, d, unknown_group)


def with_f(body: str, *views: str) -> str:
    return O.with_f(body, *views)


def with_fs(body: str, *views: str) -> str:
    return O.with_f(body, O.FS_VIEW, *views)


def with_fg(body: str, *views: str) -> str:
    return O.with_f(body, O.FG_VIEW, *views)


def with_clean(body: str, unknown_group: int | None = None) -> str:
    return "WITH " + O.clean_views(unknown_group) + "\n" + body


# Registering modules (import for side effects, in inventory order).
from . import q_ingest, q_profile, q_trend, q_breakdown, q_analyze, q_geo  # noqa: E402,F401
