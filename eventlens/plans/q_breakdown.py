"""Plans K1-K12 (category, entity and geography breakdowns)."""

from __future__ import annotations

from ..operators import breakdown as K
from . import oracle as O
from .registry import F, R, RS, plan, with_f, with_fs


@plan("industry_breakdown", with_f(f"""
SELECT industry, count(DISTINCT company) AS num_companies, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {O.int_avg('total_laid_off')} AS avg_laid_off
FROM F WHERE industry <> 'Unknown' AND total_laid_off IS NOT NULL GROUP BY industry"""))
def industry_breakdown(spark, d):
    return K.industry_breakdown(F(spark, d), R)


@plan("stage_breakdown", with_f(f"""
SELECT stage, count(DISTINCT company) AS num_companies, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {O.int_avg('total_laid_off')} AS avg_laid_off,
       sum({O.cents('funds_raised_millions')}) / 100.0 AS total_funds_raised
FROM F WHERE stage <> 'Unknown' AND total_laid_off IS NOT NULL AND funds_raised_millions IS NOT NULL
GROUP BY stage"""))
def stage_breakdown(spark, d):
    return K.stage_breakdown(F(spark, d), R)


@plan("stage_year_cohort", with_f("""
SELECT CAST(year(date) AS INTEGER) AS year, stage, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off
FROM F WHERE date IS NOT NULL AND stage NOT IN ('Unknown') AND total_laid_off IS NOT NULL
GROUP BY 1, 2"""))
def stage_year_cohort(spark, d):
    return K.stage_year_cohort(F(spark, d), R)


@plan("top_entities", with_f("""
SELECT company, industry, country, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off, count(*) AS num_rounds
FROM F WHERE total_laid_off IS NOT NULL GROUP BY company, industry, country
ORDER BY total_laid_off DESC, company, industry, country LIMIT 10"""))
def top_entities(spark, d):
    return K.top_entities(F(spark, d), R, n=10)


@plan("shutdowns", with_f("""
SELECT company, industry, country, funds_raised_millions, date FROM F WHERE percentage_laid_off = 1"""))
def shutdowns(spark, d):
    return K.shutdowns(F(spark, d), R)


@plan("outliers_vs_mean", with_fs(f"""
, G AS (SELECT {O.int_avg('total_laid_off')} AS global_avg FROM FS WHERE total_laid_off IS NOT NULL),
H AS (SELECT FS.* FROM FS, G WHERE FS.total_laid_off > 2 * G.global_avg),
HA AS (SELECT {O.int_avg('total_laid_off')} AS outlier_avg FROM H)
SELECT company, industry, country, total_laid_off, global_avg, outlier_avg FROM H, G, HA"""))
def outliers_vs_mean(spark, d):
    return K.outliers_vs_mean(F(spark, d), RS, factor=2)


@plan("top_k_per_group", with_f("""
, G AS (SELECT CAST(year(date) AS INTEGER) AS year, company, industry,
               CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off
        FROM F WHERE date IS NOT NULL AND total_laid_off IS NOT NULL GROUP BY 1, 2, 3),
RK AS (SELECT *, CAST(rank() OVER (PARTITION BY year ORDER BY total_laid_off DESC) AS INTEGER) AS rnk FROM G)
SELECT year, rnk, company, industry, total_laid_off FROM RK WHERE rnk <= 5"""))
def top_k_per_group(spark, d):
    return K.top_k_per_group(F(spark, d), R, k=5)


@plan("country_breakdown", with_f(f"""
SELECT country, count(DISTINCT company) AS num_companies, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {O.int_avg('total_laid_off')} AS avg_laid_off
FROM F WHERE total_laid_off IS NOT NULL GROUP BY country"""))
def country_breakdown(spark, d):
    return K.country_breakdown(F(spark, d), R)


def city_sql(view: str = "F") -> str:
    """City figures: events with a measure, funds and a positive rate; a city's rank counts the larger cities of its country."""
    return f"""CE AS (
  SELECT country, location AS city, company, total_laid_off AS t, CAST(round(funds_raised_millions * 100.0) AS HUGEINT) AS cents,
         CAST(round(CAST(total_laid_off AS DOUBLE) / percentage_laid_off * 1000000.0) AS HUGEINT) AS micro_headcount
  FROM {view} WHERE total_laid_off + funds_raised_millions IS NOT NULL AND percentage_laid_off > 0),
CD AS (
  SELECT country, city, count(DISTINCT company) AS num_companies, CAST(sum(t) AS BIGINT) AS total_laid_off, {O.int_avg('t')} AS avg_laid_off, {O.ratio('sum(t)', 'count(t)', 2)} AS avg_exact,
         {O.ratio('sum(cents)', '100 * count(*)', 2)} AS avg_funds_raised,
         {O.pct('sum(t) * 1000000', 'sum(micro_headcount)', 10, 2)} AS layoff_rate_raw
  FROM CE GROUP BY ALL),
CITY AS (
  SELECT country, CAST((SELECT count(*) FROM CD y WHERE y.country = x.country AND (y.total_laid_off, x.city) > (x.total_laid_off, y.city)) + 1
                       AS INTEGER) AS city_rank, * EXCLUDE (country)
  FROM CD x)"""


CITY_SQL = city_sql()


@plan("city_breakdown", with_f("SELECT * FROM CITY", CITY_SQL))
def city_breakdown(spark, d):
    return K.city_breakdown(F(spark, d), R)


PEARSON_SQL = """round(covar_pop(CAST(total_laid_off AS DOUBLE), funds_raised_millions)
       / nullif(stddev_pop(CAST(total_laid_off AS DOUBLE)) * stddev_pop(funds_raised_millions), 0), 3)"""


@plan("pearson", with_f(f"""
SELECT {PEARSON_SQL} AS pearson_correlation
FROM F WHERE total_laid_off IS NOT NULL AND funds_raised_millions IS NOT NULL"""))
def pearson(spark, d):
    return K.pearson(F(spark, d), R.total, R.funds)


@plan("correlation_strength", with_f(f"""
, P AS (SELECT {PEARSON_SQL} AS pearson_correlation
        FROM F WHERE total_laid_off IS NOT NULL AND funds_raised_millions IS NOT NULL)
SELECT pearson_correlation,
       CASE WHEN abs(pearson_correlation) < 0.3 THEN 'weak' WHEN abs(pearson_correlation) < 0.6 THEN 'moderate'
            WHEN pearson_correlation IS NOT NULL THEN 'strong' END AS strength,
       CASE WHEN pearson_correlation > 0 THEN 'positive' WHEN pearson_correlation < 0 THEN 'inverse'
            WHEN pearson_correlation = 0 THEN 'none' END AS relation
FROM P"""))
def correlation_strength(spark, d):
    return K.correlation_strength(K.pearson(F(spark, d), R.total, R.funds))


@plan("share_of_events", with_f(f"""
, G AS (SELECT country AS value, count(*) AS events FROM F GROUP BY country),
N AS (SELECT count(*) AS n FROM F)
SELECT value, events, {O.ratio('events * 100', 'n', 1)} AS share_pct FROM G, N"""))
def share_of_events(spark, d):
    return K.share_of_events(F(spark, d), R.country)
