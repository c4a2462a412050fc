"""Map-ready geographic datasets and dashboard datasets (data only; drawing
is not part of the library).

All inputs here are already aggregated per city or country, so the windows
over them (maxima, ranks) see at most one row per city.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent, ratio, safe_div, scaled
from ..roles import DEFAULT, Roles
from ._common import c, not_null, ordered, whole, year_of
from .breakdown import city_breakdown, industry_breakdown

# Fixed values of the map styling that shape data: intensity gamma, bubble
# radius range and the radius above which a bubble gets a label.
GAMMA = 0.4
R_MIN, R_MAX, LABEL_AT = 4, 28, 8


def city_map_rows(df: DataFrame, r: Roles = DEFAULT, coords: DataFrame | None = None,
                  order: bool = True) -> DataFrame:
    """City aggregates with coordinates: country, city, num_companies,
    total_laid_off, layoff_rate_raw, lat, lng (NULL when the lookup has no
    entry). Both sides are small when joined: one row per city, and the lookup."""
    city = city_breakdown(df, r, order=False)
    cols = ["country", "city", "num_companies", "total_laid_off", "layoff_rate_raw"]
    if coords is None:
        out = city.select(*cols, F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    else:
        out = (city.join(coords.select("country", "city", "lat", "lng"), ["country", "city"], "left")
                   .select(*cols, "lat", "lng"))
    return ordered(out, order, "country", F.desc("total_laid_off"), "city")


def country_totals(city: DataFrame, order: bool = True) -> DataFrame:
    """Per country: country_total (sum over its cities), num_cities, and the
    maxima used for colour scaling: max_country_total, max_city_total."""
    g = city.groupBy("country").agg(F.sum("total_laid_off").cast("long").alias("country_total"),
                                    F.count(F.lit(1)).alias("num_cities"),
                                    F.max("total_laid_off").alias("_max_city"))
    out = g.select("country", "country_total", "num_cities",
                   F.max("country_total").over(whole()).alias("max_country_total"),
                   F.max("_max_city").over(whole()).cast("long").alias("max_city_total"))
    return ordered(out, order, F.desc("country_total"), "country")


def harmonize_names(df: DataFrame, col: str, lookup: DataFrame,
                    external: str = "external_name", internal: str = "internal_name") -> DataFrame:
    """Replace values found in a name lookup (external -> internal); others
    stay unchanged. Left join on the small lookup + coalesce."""
    lk = lookup.select(c(external).alias("_ext"), c(internal).alias("_int"))
    j = df.join(lk, df[col] == lk["_ext"], "left")
    return j.select(*[F.coalesce(c("_int"), df[x]).alias(x) if x == col else df[x] for x in df.columns])


def intensity(df: DataFrame, col: str, gamma: float = GAMMA, scale: int = 6) -> DataFrame:
    """Adds ``intensity`` = (value / max value) ** gamma in 0..1 (colour ramp
    position). For aggregated frames (one row per country or city)."""
    t = F.pow(safe_div(col, F.max(col).over(whole())), F.lit(gamma))
    return df.withColumn("intensity", F.round(t, scale))


def bubble_size(city: DataFrame, col: str = "total_laid_off", r_min: float = R_MIN, r_max: float = R_MAX,
                label_at: float = LABEL_AT, scale: int = 6) -> DataFrame:
    """Adds ``radius`` on a square-root scale from 0..(largest city of the
    country) to r_min..r_max, and ``show_label`` (radius > label_at)."""
    local_max = F.max(col).over(Window.partitionBy("country"))
    den = F.sqrt(local_max.cast("double"))
    t = F.when(den != 0, F.sqrt(c(col).cast("double")) / den).otherwise(F.lit(0.5))
    radius = F.lit(float(r_min)) * (F.lit(1.0) - t) + F.lit(float(r_max)) * t
    return city.withColumn("radius", F.round(radius, scale)).withColumn("show_label", c("radius") > label_at)


def city_panel(city: DataFrame, order: bool = True) -> DataFrame:
    """Country panel from city aggregates, as the map's side panel computes it:
    country_total, num_cities, companies_sum (per-city distinct companies added
    up, so an entity present in two cities counts twice) and avg_city_rate
    (unweighted mean of the city rates, 1 dp)."""
    out = city.groupBy("country").agg(
        F.sum("total_laid_off").cast("long").alias("country_total"),
        F.count(F.lit(1)).alias("num_cities"),
        F.sum("num_companies").cast("long").alias("companies_sum"),
        ratio(F.sum((c("layoff_rate_raw") * 100).cast("long")), F.count("layoff_rate_raw") * 100, 1)
        .alias("avg_city_rate"))
    return ordered(out, order, F.desc("country_total"), "country")


def country_panel(df: DataFrame, r: Roles = DEFAULT, order: bool = True) -> DataFrame:
    """`city_panel` over the event table's city aggregates, plus the corrected
    figures from the events themselves: distinct_companies and
    weighted_rate_pct (total / estimated headcount, 2 dp). Both sides are
    per-country aggregates, so the join is between two small frames."""
    panel = city_panel(city_breakdown(df, r, order=False), order=False)
    base = (df.filter(not_null(r.total, r.funds, r.pct) & (c(r.pct) > 0))
              .groupBy(c(r.country).alias("country"))
              .agg(F.countDistinct(r.company).alias("distinct_companies"),
                   F.sum(r.total).alias("_t"), F.sum(scaled(safe_div(r.total, r.pct), 6)).alias("_est")))
    out = panel.join(base, "country").select(
        "country", "country_total", "num_cities", "companies_sum", "avg_city_rate", "distinct_companies",
        percent(c("_t").cast("decimal(38,0)") * F.lit(1_000_000), "_est", 2).alias("weighted_rate_pct"))
    return ordered(out, order, F.desc("country_total"), "country")


def city_bars(city: DataFrame, order: bool = True) -> DataFrame:
    """Per country, cities ranked by total with pct_of_max = total as a whole
    percent of the country's largest city."""
    w = Window.partitionBy("country")
    out = city.select(
        "country", F.row_number().over(w.orderBy(F.desc("total_laid_off"), "city")).alias("bar_rank"),
        "city", "total_laid_off", "num_companies", "layoff_rate_raw",
        percent("total_laid_off", F.max("total_laid_off").over(w), 0).cast("int").alias("pct_of_max"))
    return ordered(out, order, "country", "bar_rank")


def kpi_cards(df: DataFrame, r: Roles = DEFAULT, approx: bool = False) -> DataFrame:
    """One row: total_laid_off, num_companies, num_countries, avg_layoff_rate
    (mean of positive rates, 2 dp). ``approx`` counts distinct values with
    HyperLogLog (no distinct shuffle)."""
    micro = F.when(c(r.pct) > 0, scaled(r.pct, 6))
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(F.sum(r.total).cast("long").alias("total_laid_off"),
                  distinct(r.company).alias("num_companies"),
                  distinct(r.country).alias("num_countries"),
                  ratio(F.sum(micro), F.count(micro) * 1_000_000, 2).alias("avg_layoff_rate"))


def top_industries(df: DataFrame, r: Roles = DEFAULT, n: int = 10) -> DataFrame:
    """The ``n`` industries with the largest total (see `industry_breakdown`)."""
    return industry_breakdown(df, r, order=False).orderBy(F.desc("total_laid_off"), "industry").limit(n)


def slice_events(df: DataFrame, r: Roles = DEFAULT, years=None, countries=None, industries=None,
                 stages=None, year_column: str = "event_year") -> DataFrame:
    """Dashboard slicers: keep events in the given years / countries /
    industries / stages (None = no restriction). The year test is also
    written as a date range so it reaches the parquet scan, and on a table
    partitioned by ``year_column`` it prunes partition folders."""
    cond = F.lit(True)
    if years:
        ys = sorted(set(int(y) for y in years))
        cond = cond & (c(r.date) >= F.make_date(F.lit(ys[0]), F.lit(1), F.lit(1))) \
                    & (c(r.date) < F.make_date(F.lit(ys[-1] + 1), F.lit(1), F.lit(1))) \
                    & year_of(r).isin(ys)
        if year_column in df.columns:   # a table written by write_event_table: prune folders
            cond = cond & c(year_column).isin(ys)
    for col, vals in ((r.country, countries), (r.industry, industries), (r.stage, stages)):
        if vals:
            cond = cond & c(col).isin(list(vals))
    return df.filter(cond)



