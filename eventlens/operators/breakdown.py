"""Category, entity and geography breakdowns, top-k, outliers, correlation.

All are grouped aggregates with partial (map-side) aggregation, so a hot key
(one company or country holding a third of all rows) is combined inside each
task before the shuffle. Rankings carry a total order (value, then names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import int_avg, pct_ratio, percent, ratio, relation, safe_div, scaled, strength
from ..roles import DEFAULT, Roles
from ._common import c, distinct_count, excluding, not_null, ordered, year_of

UNKNOWN = "Unknown"


def industry_breakdown(df: DataFrame, r: Roles = DEFAULT, exclude=UNKNOWN, approx: bool = False,
                       order: bool = True) -> DataFrame:
    """industry, num_companies, total_laid_off, avg_laid_off (integer average)."""
    out = (df.filter(excluding(r.industry, exclude) & c(r.total).isNotNull())
             .groupBy(c(r.industry).alias("industry"))
             .agg(distinct_count(r.company, approx).alias("num_companies"),
                  F.sum(r.total).cast("long").alias("total_laid_off"),
                  int_avg(r.total).alias("avg_laid_off")))
    return ordered(out, order, F.desc("total_laid_off"), "industry")


def stage_breakdown(df: DataFrame, r: Roles = DEFAULT, exclude=UNKNOWN, approx: bool = False,
                    order: bool = True) -> DataFrame:
    """stage, num_companies, total_laid_off, avg_laid_off, total_funds_raised.

    Only rows with funds present take part; funds are summed in exact cents.
    """
    out = (df.filter(excluding(r.stage, exclude) & not_null(r.total, r.funds))
             .groupBy(c(r.stage).alias("stage"))
             .agg(distinct_count(r.company, approx).alias("num_companies"),
                  F.sum(r.total).cast("long").alias("total_laid_off"),
                  int_avg(r.total).alias("avg_laid_off"),
                  (F.sum(scaled(r.funds, 2)) / F.lit(100.0)).alias("total_funds_raised")))
    return ordered(out, order, F.desc("total_laid_off"), "stage")


def stage_year_cohort(df: DataFrame, r: Roles = DEFAULT, exclude=UNKNOWN, order: bool = True) -> DataFrame:
    """year, stage, total_laid_off."""
    out = (df.filter(not_null(r.date, r.total) & excluding(r.stage, exclude))
             .groupBy(year_of(r).alias("year"), c(r.stage).alias("stage"))
             .agg(F.sum(r.total).cast("long").alias("total_laid_off")))
    return ordered(out, order, "year", F.desc("total_laid_off"), "stage")


def top_entities(df: DataFrame, r: Roles = DEFAULT, n: int = 10) -> DataFrame:
    """Top-n (company, industry, country) by total: total_laid_off, num_rounds.

    orderBy + limit plans as TakeOrderedAndProject: each task keeps n rows.
    """
    g = (df.filter(c(r.total).isNotNull())
           .groupBy(c(r.company).alias("company"), c(r.industry).alias("industry"),
                    c(r.country).alias("country"))
           .agg(F.sum(r.total).cast("long").alias("total_laid_off"),
                F.count(F.lit(1)).alias("num_rounds")))
    return g.orderBy(F.desc("total_laid_off"), "company", "industry", "country").limit(n)


def shutdowns(df: DataFrame, r: Roles = DEFAULT, rate: float = 1.0, order: bool = True) -> DataFrame:
    """Events where the whole workforce went (pct = rate), by funds DESC (NULLs last)."""
    out = df.filter(c(r.pct) == F.lit(rate)).select(
        c(r.company).alias("company"), c(r.industry).alias("industry"), c(r.country).alias("country"),
        c(r.funds).alias("funds_raised_millions"), c(r.date).alias("date"))
    return ordered(out, order, F.desc_nulls_last("funds_raised_millions"), "company", "date")


def outliers_vs_mean(df: DataFrame, r: Roles = DEFAULT, factor: int = 2, order: bool = True) -> DataFrame:
    """Events whose measure exceeds ``factor`` x the (integer) mean.

    company, industry, country, total_laid_off, global_avg (the mean used as
    the threshold base) and outlier_avg (the mean over the outliers only, which
    is what the source labels as its global average). Both means are scalar
    subqueries: one aggregate job each, no window over raw rows, no join.
    """
    global_avg = df.filter(c(r.total).isNotNull()).select(int_avg(r.total)).scalar()
    hits = df.filter(c(r.total) > F.lit(factor) * global_avg)
    outlier_avg = hits.select(int_avg(r.total)).scalar()
    out = hits.select(
        c(r.company).alias("company"), c(r.industry).alias("industry"), c(r.country).alias("country"),
        c(r.total).alias("total_laid_off"), global_avg.alias("global_avg"), outlier_avg.alias("outlier_avg"))
    return ordered(out, order, F.desc("total_laid_off"), "company")


def top_k_per_group(df: DataFrame, r: Roles = DEFAULT, k: int = 5, by: str = "year", order: bool = True) -> DataFrame:
    """<by>, rnk, company, industry, total_laid_off with RANK <= k (ties kept).

    ``by`` is "year" (of the event date) or any column name. Catalyst inserts
    a partial WindowGroupLimit before the shuffle, so each task forwards at
    most ~k rows per group.
    """
    key = year_of(r) if by == "year" else c(getattr(r, by, by))
    f = df.filter(not_null(r.date, r.total)) if by == "year" else df.filter(c(r.total).isNotNull())
    g = (f.groupBy(key.alias(by), c(r.company).alias("company"), c(r.industry).alias("industry"))
          .agg(F.sum(r.total).cast("long").alias("total_laid_off")))
    w = Window.partitionBy(by).orderBy(F.desc("total_laid_off"))
    out = (g.withColumn("rnk", F.rank().over(w)).filter(c("rnk") <= k)
            .select(by, "rnk", "company", "industry", "total_laid_off"))
    return ordered(out, order, by, "rnk", "company", "industry")


def country_breakdown(df: DataFrame, r: Roles = DEFAULT, approx: bool = False, order: bool = True) -> DataFrame:
    """country, num_companies, total_laid_off, avg_laid_off."""
    out = (df.filter(c(r.total).isNotNull())
             .groupBy(c(r.country).alias("country"))
             .agg(distinct_count(r.company, approx).alias("num_companies"),
                  F.sum(r.total).cast("long").alias("total_laid_off"),
                  int_avg(r.total).alias("avg_laid_off")))
    return ordered(out, order, F.desc("total_laid_off"), "country")


def city_breakdown(df: DataFrame, r: Roles = DEFAULT, approx: bool = False, order: bool = True) -> DataFrame:
    """country, city_rank, city, num_companies, total_laid_off, avg_laid_off
    (truncated, as published), avg_exact (2 dp), avg_funds_raised, layoff_rate_raw.

    Only rows with measure, funds and a positive rate take part. The rate is
    total / estimated headcount in percent, where the headcount is the sum of
    total / pct in millionths (an exact sum, whatever the partitioning). city_rank orders by total then city name.
    """
    g = (df.filter(not_null(r.total, r.funds, r.pct) & (c(r.pct) > 0))
           .groupBy(c(r.country).alias("country"), c(r.location).alias("city"))
           .agg(distinct_count(r.company, approx).alias("num_companies"),
                F.sum(r.total).cast("long").alias("total_laid_off"),
                int_avg(r.total).alias("avg_laid_off"),
                F.sum(scaled(r.funds, 2)).alias("_cents"),
                F.count(r.funds).alias("_nf"),
                F.sum(scaled(safe_div(r.total, r.pct), 6)).alias("_est")))
    w = Window.partitionBy("country").orderBy(F.desc("total_laid_off"), "city")
    out = g.select(
        "country", F.row_number().over(w).alias("city_rank"), "city", "num_companies", "total_laid_off",
        "avg_laid_off", ratio("total_laid_off", "_nf", 2).alias("avg_exact"), ratio(c("_cents"), c("_nf") * 100, 2).alias("avg_funds_raised"),
        pct_ratio(c("total_laid_off").cast("decimal(38,0)") * F.lit(1_000_000), "_est", 10, 2).alias("layoff_rate_raw"))
    return ordered(out, order, "country", "city_rank")


def pearson(df: DataFrame, x: str = "total_laid_off", y: str = "funds_raised_millions",
            scale: int = 3) -> DataFrame:
    """One row: pearson_correlation = ROUND(r, scale) over rows with x and y.

    covar_pop / (stddev_pop * stddev_pop): partial-aggregated and numerically
    stable; NULL (not an error) for constant input or a single row.
    """
    f = df.filter(not_null(x, y))
    xd, yd = c(x).cast("double"), c(y).cast("double")
    rr = F.try_divide(F.covar_pop(xd, yd), F.stddev_pop(xd) * F.stddev_pop(yd))
    return f.agg(F.round(rr, scale).alias("pearson_correlation"))


def correlation_strength(corr: DataFrame, col: str = "pearson_correlation", cuts=(0.3, 0.6)) -> DataFrame:
    """Adds strength (weak < cuts[0] <= moderate < cuts[1] <= strong on |r|) and relation."""
    return corr.select("*", strength(col, cuts).alias("strength"), relation(col).alias("relation"))


def share_of_events(df: DataFrame, col: str, order: bool = True) -> DataFrame:
    """value, events, share_pct (percent of all events, 1 dp) for one column."""
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.groupBy(c(col).alias("value")).agg(F.count(F.lit(1)).alias("events"))
    out = g.select("value", "events", percent("events", total, 1).alias("share_pct"))
    return ordered(out, order, F.desc("events"), "value")
