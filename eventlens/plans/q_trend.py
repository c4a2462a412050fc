"""Plans T1-T6 and P1 (time analysis)."""

from __future__ import annotations

from ..operators import trend as T
from . import oracle as O
from .registry import F, R, plan, with_f

_NN = "date IS NOT NULL AND total_laid_off IS NOT NULL"


@plan("yearly_totals", with_f("""
SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       count(*) AS num_events, max(total_laid_off) AS largest_single_event
FROM F WHERE date IS NOT NULL GROUP BY 1"""))
def yearly_totals(spark, d):
    return T.yearly_totals(F(spark, d), R)


@plan("yoy_change", with_f(f"""
, A AS (SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT company) AS num_companies,
               CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off
        FROM F WHERE {_NN} GROUP BY 1),
P AS (SELECT *, lag(total_laid_off) OVER (ORDER BY year) AS prev FROM A)
SELECT year, num_companies, total_laid_off, total_laid_off - prev AS yoy_change,
       CAST({O.ratio('total_laid_off - prev', 'prev', 4)} AS DECIMAL(10,4)) AS yoy_growth_pct
FROM P"""))
def yoy_change(spark, d):
    return T.yoy_change(F(spark, d), R)


_MONTHLY = f"""M AS (SELECT CAST(year(date) AS INTEGER) AS yr, CAST(month(date) AS INTEGER) AS mn,
               strftime(date, '%Y-%m') AS yr_month, count(DISTINCT company) AS num_companies,
               CAST(sum(total_laid_off) AS BIGINT) AS monthly_total
        FROM F WHERE {_NN} GROUP BY 1, 2, 3)"""


@plan("mom_change", with_f(f"""
SELECT yr_month, num_companies, monthly_total, monthly_total - prev AS mom_change,
       CAST({O.ratio('monthly_total - prev', 'prev', 4)} AS DECIMAL(10,4)) AS mom_growth_pct
FROM (SELECT *, lag(monthly_total) OVER (ORDER BY yr, mn) AS prev FROM M)""", _MONTHLY))
def mom_change(spark, d):
    return T.mom_change(F(spark, d), R)


@plan("rolling_total", with_f("""
SELECT yr_month, monthly_total,
       CAST(sum(monthly_total) OVER (ORDER BY yr, mn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS rolling_total
FROM M""", _MONTHLY))
def rolling_total(spark, d):
    return T.rolling_total(F(spark, d), R)


@plan("annual_share", with_f(f"""
, A AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
               {O.int_avg('total_laid_off')} AS avg_laid_off,
               sum({O.cents('funds_raised_millions')}) AS cents, count(*) AS n
        FROM F WHERE {_NN} AND funds_raised_millions IS NOT NULL GROUP BY 1)
SELECT year, total_laid_off, avg_laid_off, cents / 100.0 AS total_funds_raised,
       {O.ratio('cents', 'n * 100', 2)} AS avg_funds_raised,
       CAST(total_laid_off AS DOUBLE) / CAST(sum(total_laid_off) OVER () AS DOUBLE) AS annual_percentage
FROM A"""))
def annual_share(spark, d):
    return T.annual_share(F(spark, d), R)


@plan("peak_month", with_f("""
SELECT yr_month, monthly_total FROM M ORDER BY monthly_total DESC, yr_month LIMIT 1""", _MONTHLY))
def peak_month(spark, d):
    return T.peak_month(F(spark, d), R)


@plan("peak_root_cause", with_f(f"""
, B AS (SELECT *, date_trunc('month', date) AS m FROM F WHERE {_NN}),
MT AS (SELECT m, CAST(sum(total_laid_off) AS BIGINT) AS t FROM B GROUP BY m),
PK AS (SELECT m AS peak, t AS peak_t FROM MT ORDER BY t DESC, m LIMIT 1),
X AS (SELECT B.*, PK.peak, PK.peak_t FROM B, PK WHERE B.m = PK.peak OR B.m = PK.peak - INTERVAL 1 MONTH),
G AS (
  SELECT industry, stage, country, company,
         GROUPING(industry) AS g0, GROUPING(stage) AS g1, GROUPING(country) AS g2, GROUPING(company) AS g3,
         CAST(sum(CASE WHEN m = peak THEN total_laid_off END) AS BIGINT) AS pk,
         CAST(sum(CASE WHEN m <> peak THEN total_laid_off END) AS BIGINT) AS pv,
         max(peak) AS peak, max(peak_t) AS peak_t
  FROM X GROUP BY GROUPING SETS ((industry), (stage), (country), (company)))
SELECT CASE WHEN g0 = 0 THEN 'industry' WHEN g1 = 0 THEN 'stage' WHEN g2 = 0 THEN 'country' ELSE 'company' END
         AS dimension,
       CASE WHEN g0 = 0 THEN industry WHEN g1 = 0 THEN stage WHEN g2 = 0 THEN country ELSE company END AS value,
       strftime(peak, '%Y-%m') AS peak_month,
       coalesce(pk, 0) AS peak_total,
       {O.ratio('coalesce(pk, 0) * 100', 'peak_t', 2)} AS share_of_peak_pct,
       coalesce(pv, 0) AS prev_month_total,
       coalesce(pk, 0) - coalesce(pv, 0) AS delta_vs_prev_month
FROM G"""))
def peak_root_cause(spark, d):
    return T.peak_root_cause(F(spark, d), R)
