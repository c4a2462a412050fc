"""Plans E1-E6 (profiling and KPIs)."""

from __future__ import annotations

from ..operators import clean as C
from ..operators import profile as P
from . import oracle as O
from .registry import F, RAW, R, plan, with_clean, with_f

CLEAN_COLS = ("company", "location", "country", "industry", "stage", "date", "total_laid_off",
              "percentage_laid_off", "funds_raised_millions")


@plan("row_counts", with_clean("""
SELECT 'raw' AS table_name, count(*) AS num_rows FROM RR
UNION ALL SELECT 'clean', count(*) FROM C"""))
def row_counts(spark, d):
    raw = RAW(spark, d)
    return P.row_counts({"raw": raw, "clean": C.clean_events(raw)})


@plan("null_profile", with_clean("\nUNION ALL\n".join(
    f"SELECT '{x}' AS \"column\", count(*) AS total_rows, count(*) - count({x}) AS null_count, "
    f"{O.ratio(f'(count(*) - count({x})) * 100', 'count(*)', 1)} AS null_percentage FROM C"
    for x in CLEAN_COLS), unknown_group=7))
def null_profile(spark, d):
    return P.null_profile(C.clean_events(RAW(spark, d, unknown_group=7)))


@plan("year_coverage", with_f("""
SELECT CAST(year(date) AS INTEGER) AS year, min(date) AS first_event, max(date) AS last_event, count(*) AS num_events
FROM F WHERE date IS NOT NULL GROUP BY 1"""))
def year_coverage(spark, d):
    return P.year_coverage(F(spark, d), R)


_KPI_VALUES = [
    "CAST(count(DISTINCT company) AS DOUBLE)",
    "CAST(count(DISTINCT industry) AS DOUBLE)",
    "CAST(count(DISTINCT country) AS DOUBLE)",
    "CAST(sum(total_laid_off) AS DOUBLE)",
    f"CAST({O.int_avg('total_laid_off')} AS DOUBLE)",
    f"sum({O.cents('funds_raised_millions')}) / 100.0",
    O.ratio(f"sum({O.cents('funds_raised_millions')})", "count(funds_raised_millions) * 100", 2),
    O.ratio("sum(CASE WHEN percentage_laid_off > 0 THEN CAST(round(percentage_laid_off * 1000000.0) AS BIGINT) END)",
            "count(CASE WHEN percentage_laid_off > 0 THEN 1 END) * 1000000", 2),
]


@plan("kpi_summary", with_f("\nUNION ALL\n".join(
    f"SELECT '{n}' AS measure_name, CAST({v} AS DOUBLE) AS measure_value FROM F"
    for n, v in zip(P.KPI_NAMES, _KPI_VALUES))))
def kpi_summary(spark, d):
    return P.kpi_summary(F(spark, d), R)


@plan("workforce_estimate", with_f(f"""
, E AS (SELECT sum(round(CAST(total_laid_off AS DOUBLE) / percentage_laid_off)) AS est,
               CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off
        FROM F WHERE total_laid_off IS NOT NULL AND percentage_laid_off IS NOT NULL AND percentage_laid_off > 0)
SELECT CAST(floor(est / 1000.0) AS BIGINT) AS estimated_total_employees, CAST(est AS BIGINT) AS estimated_employees,
       total_laid_off, {O.ratio('total_laid_off', 'CAST(est AS BIGINT)', 2)} AS overall_layoff_rate
FROM E"""))
def workforce_estimate(spark, d):
    return P.workforce_estimate(F(spark, d), R)


@plan("null_rate_report", with_f(f"""
, N AS (SELECT count(*) AS total_rows,
               count(CASE WHEN total_laid_off IS NULL OR percentage_laid_off IS NULL THEN 1 END) AS rows_missing_any
        FROM F)
SELECT total_rows, rows_missing_any, {O.ratio('rows_missing_any * 100', 'total_rows', 1)} AS pct_missing_any FROM N"""))
def null_rate_report(spark, d):
    return P.null_rate_report(F(spark, d), (R.total, R.pct))
