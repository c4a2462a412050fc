"""Profiling and headline KPIs, each in a single aggregation pass.

The source scans the table once per column / per metric and glues the
results with UNION ALL; here one global aggregate computes everything and a
narrow `unpivot` turns the single result row into report rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import int_avg, percent, ratio, safe_div, scaled
from ..roles import DEFAULT, Roles
from ._common import c, distinct_count, not_null, ordered, year_of

# KPI measure names, in report order.
KPI_NAMES = (
    "Number of Companies",
    "Number of Industries",
    "Number of Countries",
    "Total Layoffs",
    "Average Layoffs",
    "Total Funds Raised",
    "Average Funds Raised",
    "Average Layoff Rate",
)


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """table_name, num_rows for each named DataFrame."""
    out = None
    for name, df in named.items():
        part = df.agg(F.count(F.lit(1)).alias("num_rows")).select(F.lit(name).alias("table_name"), "num_rows")
        out = part if out is None else out.unionByName(part)
    return out


def null_profile(df: DataFrame, order: bool = True, display: bool = False) -> DataFrame:
    """column, total_rows, null_count, null_percentage (1 dp), for every column.

    One scan: count(*) and count(col) for all columns in one aggregate, then
    unpivot. Sorted by null_count numerically (not by a formatted string).
    ``display`` adds formatted text columns ('1,234', '33.3%') for reports.
    """
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[(F.count(F.lit(1)) - F.count(F.col(f"`{x}`"))).alias(f"_n{i}") for i, x in enumerate(cols)])
    long = agg.unpivot(["_total"], [f"_n{i}" for i in range(len(cols))], "_idx", "null_count")
    name = F.element_at(F.array(*[F.lit(x) for x in cols]),
                        F.regexp_extract("_idx", r"(\d+)", 1).cast("int") + 1)
    out = long.select(name.alias("column"), c("_total").alias("total_rows"), "null_count",
                      percent("null_count", "_total", 1).alias("null_percentage"))
    if display:
        out = out.select("*", F.format_number("total_rows", 0).alias("total_rows_text"),
                         F.format_number("null_count", 0).alias("null_count_text"),
                         F.concat(F.format_number("null_percentage", 1), F.lit("%")).alias("null_percentage_text"))
    return ordered(out, order, F.desc("null_count"), "column")


def year_coverage(df: DataFrame, r: Roles = DEFAULT, order: bool = True) -> DataFrame:
    """year, first_event, last_event, num_events (rows with a date)."""
    out = (df.filter(c(r.date).isNotNull()).groupBy(year_of(r).alias("year"))
             .agg(F.min(r.date).alias("first_event"), F.max(r.date).alias("last_event"),
                  F.count(F.lit(1)).alias("num_events")))
    return ordered(out, order, "year")


def kpi_summary(df: DataFrame, r: Roles = DEFAULT, approx: bool = False) -> DataFrame:
    """measure_name, measure_value (double): eight headline measures.

    Distinct companies / industries / countries, total and integer-average
    measure, total and average funds (2 dp, exact cents), average rate over
    rows with a positive rate (2 dp). One aggregate over one scan.
    """
    pos = c(r.pct) > 0
    micro = F.when(pos, scaled(r.pct, 6))
    cents = scaled(r.funds, 2)
    values = [
        distinct_count(r.company, approx),
        distinct_count(r.industry, approx),
        distinct_count(r.country, approx),
        F.sum(r.total),
        int_avg(r.total),
        F.sum(cents) / F.lit(100.0),
        ratio(F.sum(cents), F.count(r.funds) * 100, 2),
        ratio(F.sum(micro), F.count(micro) * 1_000_000, 2),
    ]
    row = df.agg(*[v.cast("double").alias(f"m{i}") for i, v in enumerate(values)])
    long = row.unpivot([], [f"m{i}" for i in range(len(values))], "_m", "measure_value")
    name = F.element_at(F.array(*[F.lit(n) for n in KPI_NAMES]),
                        F.regexp_extract("_m", r"(\d+)", 1).cast("int") + 1)
    return long.select(name.alias("measure_name"), "measure_value")


def workforce_estimate(df: DataFrame, r: Roles = DEFAULT, unit: int = 1000) -> DataFrame:
    """One row: estimated_total_employees (in ``unit``s, truncated),
    estimated_employees (raw), total_laid_off, overall_layoff_rate (2 dp).

    Each row's headcount is round(total / pct); rows need total and a
    positive pct. The per-row estimates are whole numbers summed as decimals,
    so the total is exact in any order and at any size.
    """
    # whole numbers summed as DECIMAL(38,0): exact beyond 2^53, in any order
    est = F.round(safe_div(r.total, r.pct), 0).cast("decimal(38,0)")
    f = df.filter(not_null(r.total, r.pct) & (c(r.pct) > 0))
    g = f.agg(F.sum(est).alias("_est"), F.sum(r.total).cast("long").alias("total_laid_off"))
    return g.select(
        F.floor(c("_est") / F.lit(float(unit))).cast("long").alias("estimated_total_employees"),
        c("_est").cast("long").alias("estimated_employees"),
        "total_laid_off",
        ratio(c("total_laid_off"), c("_est").cast("long"), 2).alias("overall_layoff_rate"))


def null_rate_report(df: DataFrame, cols=("total_laid_off", "percentage_laid_off")) -> DataFrame:
    """One row: total_rows, rows_missing_any (any listed column NULL),
    pct_missing_any (percent, 1 dp)."""
    missing = F.lit(False)
    for x in cols:
        missing = missing | c(x).isNull()
    g = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(missing).alias("rows_missing_any"))
    return g.select("total_rows", "rows_missing_any",
                    percent("rows_missing_any", "total_rows", 1).alias("pct_missing_any"))
