"""Small shared pieces for the operator modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..roles import Roles

# A window over an *aggregated* frame whose row count is bounded by a category
# or calendar cardinality (years, months, stages, segments): Spark evaluates it
# in one partition, which is fine for tens-to-thousands of rows. Never used
# on raw event rows.
def whole() -> Window:
    return Window.partitionBy()


def c(name: str) -> Column:
    return F.col(name)


def year_of(r: Roles) -> Column:
    return F.year(c(r.date)).cast("int")


def month_key(r: Roles) -> Column:
    return F.date_format(c(r.date), "yyyy-MM")


def not_null(*names: str) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & c(n).isNotNull()
    return cond


def excluding(name: str, values) -> Column:
    """`name NOT IN (values)`; NULL is dropped too (three-valued logic)."""
    if isinstance(values, str):
        values = [values]
    return ~c(name).isin(list(values)) if values else c(name).isNotNull()


def ordered(df: DataFrame, order: bool, *keys) -> DataFrame:
    return df.orderBy(*keys) if order else df


def distinct_count(col: str, approx: bool) -> Column:
    return F.approx_count_distinct(col) if approx else F.countDistinct(col)


def held(df: DataFrame) -> DataFrame:
    """`df` with later filters kept above it.

    Branches that filter one frame differently then share its plan, and so its
    exchange: what is below is read once. (Catalyst moves no filter past a row
    number that the filter needs.)
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).filter("_at >= 0").drop("_at")


def one_plan(df: DataFrame, keys: list[str]) -> DataFrame:
    """`held`, with the columns besides `keys` kept together, so that branches using some of them share one plan too."""
    rest = [x for x in df.columns if x not in keys]
    packed = df.select(*keys, F.struct(*rest).alias("_row"), F.monotonically_increasing_id().alias("_at"))
    return packed.filter("_at >= 0").select(*keys, *[F.col(f"_row.{x}").alias(x) for x in rest])
