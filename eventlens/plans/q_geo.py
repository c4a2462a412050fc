"""Plans G1-G7 and D1-D3 (geographic and dashboard datasets)."""

from __future__ import annotations

from ..operators import breakdown as K
from ..operators import cells as X
from ..operators import geo as G
from ..sources import city_coordinates, country_name_lookup
from ..sources.fixtures import place_view
from . import oracle as O
from .q_breakdown import CITY_SQL, city_sql
from .registry import F, R, plan, with_f


# The lookups written out again: the places that the fixture has, and the names that differ.
_NAMES = """NM AS (SELECT * FROM (VALUES ('United States of America', 'United States'), ('Russian Federation', 'Russia'),
  ('Republic of Korea', 'South Korea'), ('Iran (Islamic Republic of)', 'Iran')) AS t(external_name, internal_name))"""
_HARMONIZED = """HV AS (SELECT PV.* REPLACE (coalesce(internal_name, country) AS country) FROM PV LEFT JOIN NM ON country = external_name)"""
_COORDS = """CO AS (SELECT * FROM (VALUES ('Argentina', 'Buenos Aires', -34.61, -58.38), ('Brazil', 'Sao Paulo', -23.55, -46.63),
  ('Canada', 'Toronto', 43.65, -79.38), ('China', 'Beijing', 39.90, 116.41), ('France', 'Paris', 48.86, 2.35), ('Germany', 'Berlin', 52.52, 13.40),
  ('India', 'Bengaluru', 12.97, 77.59), ('Indonesia', 'Jakarta', -6.21, 106.85), ('Kenya', 'Nairobi', -1.29, 36.82), ('Russia', 'Moscow', 55.75, 37.62),
  ('United Kingdom', 'London', 51.51, -0.13), ('United States', 'Seattle', 47.61, -122.33)) AS t(country, city, lat, lng))"""


def _places(spark, d):
    return G.harmonize_names(place_view(spark, d), "country", country_name_lookup(spark))


@plan("city_map_rows", with_f("""
SELECT CITY.country, CITY.city, num_companies, total_laid_off, layoff_rate_raw, CAST(CO.lat AS DOUBLE) AS lat, CAST(CO.lng AS DOUBLE) AS lng
FROM CITY LEFT JOIN CO USING (country, city)""", O.PLACE_VIEW, _NAMES, _HARMONIZED, city_sql("HV"), _COORDS))
def city_map_rows(spark, d):
    return G.city_map_rows(_places(spark, d), R, city_coordinates(spark))


_COUNTRY_TOTALS = """CT AS (
  SELECT country, country_total, num_cities, max(country_total) OVER () AS max_country_total,
         CAST(max(mx) OVER () AS BIGINT) AS max_city_total
  FROM (SELECT country, CAST(sum(total_laid_off) AS BIGINT) AS country_total, count(*) AS num_cities,
               max(total_laid_off) AS mx FROM CITY GROUP BY country) X)"""


@plan("country_totals", with_f("SELECT * FROM CT", CITY_SQL, _COUNTRY_TOTALS))
def country_totals(spark, d):
    return G.country_totals(K.city_breakdown(F(spark, d), R, order=False))


@plan("harmonize_names", with_f(f"""
SELECT country, count(DISTINCT company) AS num_companies, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {O.int_avg('total_laid_off')} AS avg_laid_off
FROM HV WHERE total_laid_off IS NOT NULL GROUP BY country""", O.PLACE_VIEW, _NAMES, _HARMONIZED))
def harmonize_names(spark, d):
    return K.country_breakdown(_places(spark, d), R, order=False)


@plan("intensity", with_f("""
SELECT *, round(pow(CAST(country_total AS DOUBLE) / nullif(CAST(max(country_total) OVER () AS DOUBLE), 0), 0.4), 6)
         AS intensity
FROM CT""", CITY_SQL, _COUNTRY_TOTALS))
def intensity(spark, d):
    return G.intensity(G.country_totals(K.city_breakdown(F(spark, d), R, order=False), order=False), "country_total")


@plan("bubble_size", with_f("""
SELECT * EXCLUDE (t), round(4.0 * (1.0 - t) + 28.0 * t, 6) AS radius,
       round(4.0 * (1.0 - t) + 28.0 * t, 6) > 8 AS show_label
FROM (
  SELECT *, CASE WHEN sqrt(CAST(max(total_laid_off) OVER (PARTITION BY country) AS DOUBLE)) <> 0
                 THEN sqrt(CAST(total_laid_off AS DOUBLE))
                      / sqrt(CAST(max(total_laid_off) OVER (PARTITION BY country) AS DOUBLE))
                 ELSE 0.5 END AS t
  FROM CITY) X""", CITY_SQL))
def bubble_size(spark, d):
    return G.bubble_size(K.city_breakdown(F(spark, d), R, order=False))


@plan("country_panel", with_f(f"""
, P AS (SELECT country, CAST(sum(total_laid_off) AS BIGINT) AS country_total, count(*) AS num_cities,
               CAST(sum(num_companies) AS BIGINT) AS companies_sum,
               {O.ratio('sum(CAST(layoff_rate_raw * 100 AS BIGINT))', 'count(layoff_rate_raw) * 100', 1)}
                 AS avg_city_rate
        FROM CITY GROUP BY country),
B AS (SELECT country, count(DISTINCT company) AS distinct_companies,
             sum(total_laid_off) AS t, sum(CAST(round(total_laid_off / percentage_laid_off * 1000000.0) AS HUGEINT)) AS est
      FROM F WHERE total_laid_off IS NOT NULL AND funds_raised_millions IS NOT NULL
        AND percentage_laid_off IS NOT NULL AND percentage_laid_off > 0 GROUP BY country)
SELECT P.country, country_total, num_cities, companies_sum, avg_city_rate, distinct_companies,
       {O.ratio('t * 100000000', 'est', 2)} AS weighted_rate_pct
FROM P JOIN B ON P.country = B.country""", CITY_SQL))
def country_panel(spark, d):
    return G.country_panel(F(spark, d), R)


@plan("city_bars", with_f(f"""
SELECT country, CAST(row_number() OVER (PARTITION BY country ORDER BY total_laid_off DESC, city) AS INTEGER) AS bar_rank,
       city, total_laid_off, num_companies, layoff_rate_raw,
       CAST({O.ratio('total_laid_off * 100', 'max(total_laid_off) OVER (PARTITION BY country)', 0)} AS INTEGER)
         AS pct_of_max
FROM CITY""", CITY_SQL))
def city_bars(spark, d):
    return G.city_bars(K.city_breakdown(F(spark, d), R, order=False))


@plan("kpi_cards", with_f(f"""
SELECT CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off, count(DISTINCT company) AS num_companies,
       count(DISTINCT country) AS num_countries,
       {O.ratio("sum(CASE WHEN percentage_laid_off > 0 THEN CAST(round(percentage_laid_off * 1000000.0) AS BIGINT) END)",
                "count(CASE WHEN percentage_laid_off > 0 THEN 1 END) * 1000000", 2)} AS avg_layoff_rate
FROM F"""))
def kpi_cards(spark, d):
    return G.kpi_cards(F(spark, d), R)


@plan("top_industries", with_f(f"""
SELECT industry, count(DISTINCT company) AS num_companies, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {O.int_avg('total_laid_off')} AS avg_laid_off
FROM F WHERE industry <> 'Unknown' AND total_laid_off IS NOT NULL GROUP BY industry
ORDER BY total_laid_off DESC, industry LIMIT 10"""))
def top_industries(spark, d):
    return G.top_industries(F(spark, d), R, n=10)


SLICE = dict(years=(1996, 1997), countries=("ASIA", "EUROPE"))


@plan("slice", with_f("""
SELECT * FROM F WHERE year(date) IN (1996, 1997) AND country IN ('ASIA', 'EUROPE')"""))
def slice_events(spark, d):
    return G.slice_events(F(spark, d), R, **SLICE)


_CARD_RATE = O.ratio("sum(CASE WHEN percentage_laid_off > 0 THEN CAST(round(percentage_laid_off * 1000000.0) AS BIGINT) END)",
                     "count(CASE WHEN percentage_laid_off > 0 THEN 1 END) * 1000000", 2)


@plan("slicer_cards", with_f("\nUNION ALL\n".join(f"""
SELECT '{s}' AS slicer, CAST({v} AS VARCHAR) AS value, count(*) AS num_events, CAST(sum(total_laid_off) AS BIGINT) AS total_laid_off,
       {_CARD_RATE} AS avg_layoff_rate, count(DISTINCT company) AS exact_companies, true AS within_bound
FROM F GROUP BY {v}""" for s, v in zip(X.SLICERS, ("year(date)", "country", "industry", "stage")))))
def slicer_cards(spark, d):
    return X.sketch_check(X.event_cells(F(spark, d), R), F(spark, d), R)
