"""Time analysis: yearly totals, YoY / MoM change, running totals, annual
share, peak month and the peak month's breakdown.

Each operator aggregates the raw rows first (partial aggregation, one
shuffle on the calendar key) and only then applies LAG / running windows —
those windows see one row per year or month, never raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decimal_ratio, int_avg, percent, ratio, scaled
from ..roles import DEFAULT, Roles
from ._common import c, month_key, not_null, ordered, whole, year_of


def yearly_totals(df: DataFrame, r: Roles = DEFAULT, order: bool = True) -> DataFrame:
    """year, total_laid_off, num_events, largest_single_event.

    Rows with a NULL measure still count as events.
    """
    out = (df.filter(c(r.date).isNotNull())
             .groupBy(year_of(r).alias("year"))
             .agg(F.sum(r.total).cast("long").alias("total_laid_off"),
                  F.count(F.lit(1)).alias("num_events"),
                  F.max(r.total).alias("largest_single_event")))
    return ordered(out, order, F.desc("total_laid_off"), "year")


def _annual(df: DataFrame, r: Roles) -> DataFrame:
    return (df.filter(not_null(r.date, r.total))
              .groupBy(year_of(r).alias("year"))
              .agg(F.countDistinct(r.company).alias("num_companies"),
                   F.sum(r.total).cast("long").alias("total_laid_off")))


def yoy_change(df: DataFrame, r: Roles = DEFAULT, order: bool = True) -> DataFrame:
    """year, num_companies, total_laid_off, yoy_change, yoy_growth_pct.

    yoy_growth_pct is a fraction (DECIMAL(10,4)) despite its name; NULL for the
    first year and when the previous total is 0.
    """
    annual = _annual(df, r)
    prev = F.lag("total_laid_off").over(Window.orderBy("year"))
    out = annual.select(
        "year", "num_companies", "total_laid_off",
        (c("total_laid_off") - prev).alias("yoy_change"),
        decimal_ratio(c("total_laid_off") - prev, prev, 10, 4).alias("yoy_growth_pct"))
    return ordered(out, order, "year")


def _monthly(df: DataFrame, r: Roles, companies: bool = True) -> DataFrame:
    aggs = [F.sum(r.total).cast("long").alias("monthly_total")]
    if companies:
        aggs.insert(0, F.countDistinct(r.company).alias("num_companies"))
    return (df.filter(not_null(r.date, r.total))
              .groupBy(year_of(r).alias("yr"), F.month(c(r.date)).alias("mn"), month_key(r).alias("yr_month"))
              .agg(*aggs))


def _fill_months(monthly: DataFrame) -> DataFrame:
    """Insert absent calendar months (total 0) between the first and last month."""
    start = F.to_date(F.concat(c("yr_month"), F.lit("-01")))
    bounds = monthly.agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    months = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    months = months.select(F.year("m").alias("yr"), F.month("m").alias("mn"),
                           F.date_format("m", "yyyy-MM").alias("yr_month"))
    filled = months.join(monthly, ["yr", "mn", "yr_month"], "left")
    fills = {k: 0 for k in ("num_companies", "monthly_total") if k in monthly.columns}
    return filled.fillna(fills)


def mom_change(df: DataFrame, r: Roles = DEFAULT, fill_gaps: bool = False, order: bool = True) -> DataFrame:
    """yr_month, num_companies, monthly_total, mom_change, mom_growth_pct.

    By default compares with the previous month *present* in the data; with
    ``fill_gaps`` absent months are inserted with a zero total first.
    """
    monthly = _monthly(df, r)
    if fill_gaps:
        monthly = _fill_months(monthly)
    prev = F.lag("monthly_total").over(Window.orderBy("yr", "mn"))
    out = monthly.select(
        "yr", "mn", "yr_month", "num_companies", "monthly_total",
        (c("monthly_total") - prev).alias("mom_change"),
        decimal_ratio(c("monthly_total") - prev, prev, 10, 4).alias("mom_growth_pct"))
    out = ordered(out, order, "yr", "mn")
    return out.drop("yr", "mn")


def rolling_total(df: DataFrame, r: Roles = DEFAULT, grain: str = "month", order: bool = True) -> DataFrame:
    """Cumulative total from the first period to each period.

    grain="month": yr_month, monthly_total, rolling_total;
    grain="year":  year, yearly_total, rolling_total.
    """
    running = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if grain == "year":
        g = (df.filter(not_null(r.date, r.total)).groupBy(year_of(r).alias("year"))
               .agg(F.sum(r.total).cast("long").alias("yearly_total")))
        out = g.select("year", "yearly_total",
                       F.sum("yearly_total").over(running.orderBy("year")).alias("rolling_total"))
        return ordered(out, order, "year")
    g = _monthly(df, r, companies=False)
    out = g.select("yr", "mn", "yr_month", "monthly_total",
                   F.sum("monthly_total").over(running.orderBy("yr", "mn")).alias("rolling_total"))
    return ordered(out, order, "yr", "mn").drop("yr", "mn")


def annual_share(df: DataFrame, r: Roles = DEFAULT, order: bool = True) -> DataFrame:
    """year, total_laid_off, avg_laid_off, total_funds_raised, avg_funds_raised,
    annual_percentage (a fraction of the all-years total).

    Only rows with date, measure and funds all present take part. Money is
    summed in exact cents.
    """
    cents = scaled(r.funds, 2)
    g = (df.filter(not_null(r.date, r.total, r.funds))
           .groupBy(year_of(r).alias("year"))
           .agg(F.sum(r.total).cast("long").alias("total_laid_off"),
                int_avg(r.total).alias("avg_laid_off"),
                F.sum(cents).alias("_cents"),
                F.count(F.lit(1)).alias("_n")))
    out = g.select(
        "year", "total_laid_off", "avg_laid_off",
        (c("_cents") / F.lit(100.0)).alias("total_funds_raised"),
        ratio(c("_cents"), c("_n") * 100, 2).alias("avg_funds_raised"),
        (c("total_laid_off").cast("double") / F.sum("total_laid_off").over(whole()).cast("double"))
        .alias("annual_percentage"))
    return ordered(out, order, F.desc("annual_percentage"), "year")


def peak_month(df: DataFrame, r: Roles = DEFAULT) -> DataFrame:
    """The month with the largest total (earliest month on ties): yr_month, monthly_total."""
    g = _monthly(df, r, companies=False)
    return g.orderBy(F.desc("monthly_total"), "yr_month").limit(1).select("yr_month", "monthly_total")


PEAK_DIMENSIONS = ("industry", "stage", "country", "company")


def peak_root_cause(df: DataFrame, r: Roles = DEFAULT, dims=None, order: bool = True) -> DataFrame:
    """Breakdown of the peak month by several dimensions (our definition; the
    source only names the finding).

    For each dimension value: peak-month total, its share of the peak month
    (percent, 2 dp), the previous calendar month's total and the change.
    Output: dimension, value, peak_month, peak_total, share_of_peak_pct,
    prev_month_total, delta_vs_prev_month. One pass with GROUPING SETS over
    the two months' rows; the peak month is a scalar subquery.
    """
    dims = [getattr(r, d) if hasattr(r, d) else d for d in (dims or PEAK_DIMENSIONS)]
    month = F.trunc(c(r.date), "month")
    base = df.filter(not_null(r.date, r.total))
    monthly = base.groupBy(month.alias("m")).agg(F.sum(r.total).cast("long").alias("t"))
    top = monthly.orderBy(F.desc("t"), "m").limit(1).select(F.struct("m", "t")).scalar()
    # the peak's month and total are plain columns, so the aggregate below keeps fixed-width buffers
    rows = (base.select(*[c(d) for d in dims], c(r.total).alias("_t"), month.alias("_m"), top.alias("_pk"))
                .select("*", c("_pk.m").alias("_pm"), c("_pk.t").alias("_pt")).drop("_pk")
                .filter((c("_m") == c("_pm")) | (c("_m") == F.add_months(c("_pm"), -1))))
    is_peak = c("_m") == c("_pm")
    grouped = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.sum(F.when(is_peak, c("_t"))).cast("long").alias("peak_total"),
        F.sum(F.when(~is_peak, c("_t"))).cast("long").alias("prev_total"),
        F.max("_pm").alias("_pm"), F.max("_pt").alias("_pt"),
        *[F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)])
    name = None
    for i, d in enumerate(dims):
        cond = c(f"_g{i}") == 0
        name = F.when(cond, F.lit(d)) if name is None else name.when(cond, F.lit(d))
    value = F.coalesce(*[F.when(c(f"_g{i}") == 0, c(d).cast("string")) for i, d in enumerate(dims)])
    pt = F.coalesce(c("peak_total"), F.lit(0))
    pv = F.coalesce(c("prev_total"), F.lit(0))
    out = grouped.select(
        name.alias("dimension"), value.alias("value"),
        F.date_format(c("_pm"), "yyyy-MM").alias("peak_month"),
        pt.alias("peak_total"),
        percent(pt, c("_pt"), 2).alias("share_of_peak_pct"),
        pv.alias("prev_month_total"),
        (pt - pv).alias("delta_vs_prev_month"))
    return ordered(out, order, "dimension", F.desc("peak_total"), "value")
