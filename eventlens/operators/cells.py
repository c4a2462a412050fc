"""Dashboard cells: counts and distinct-count sketches that answer any slicer without the events.

A cell holds one (year, country, industry, stage) with its event count, exact
sums and a HyperLogLog sketch of its entities. Sums and sketches merge, so the
cards of any slice come from the cells that it covers. Their number is bounded
by the category values, whatever the number of events.

The merged distinct count has a relative standard error of 1.04 / sqrt(2^lg_k);
`error_bound` gives three of these (4.9 % at the default `lg_k` of 12).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio, scaled
from ..roles import DEFAULT, Roles
from ._common import c, year_of

SLICERS = ("year", "country", "industry", "stage")
LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    """Relative error of a merged distinct count that three standard errors allow."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def event_cells(df: DataFrame, r: Roles = DEFAULT, lg_k: int = LG_K) -> DataFrame:
    """year, country, industry, stage, num_events, total_laid_off, rate_micros, num_rates, companies (sketch).

    One grouped aggregate with map-side combine. Null slicer values are cells
    of their own; a null entity is in no sketch.
    """
    micro = F.when(c(r.pct) > 0, scaled(r.pct, 6))
    keys = [year_of(r), c(r.country), c(r.industry), c(r.stage)]
    return df.groupBy(*[k.alias(s) for k, s in zip(keys, SLICERS)]).agg(
        F.count(F.lit(1)).alias("num_events"), F.sum(r.total).cast("long").alias("total_laid_off"),
        F.sum(micro).alias("rate_micros"), F.count(micro).alias("num_rates"),
        F.hll_sketch_agg(c(r.company).cast("string"), lg_k).alias("companies"))


def _cards() -> list[Column]:
    return [F.sum("num_events").alias("num_events"), F.sum("total_laid_off").cast("long").alias("total_laid_off"),
            ratio(F.sum("rate_micros"), F.sum("num_rates") * 1_000_000, 2).alias("avg_layoff_rate"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("companies")), F.lit(0)).cast("long").alias("num_companies")]


def cell_cards(cells: DataFrame, years=None, countries=None, industries=None, stages=None) -> DataFrame:
    """One row of dashboard cards for a slice (None = no restriction), merged from the cells it covers."""
    for name, values in zip(SLICERS, (years, countries, industries, stages)):
        if values:
            cells = cells.filter(c(name).isin(list(values)))
    return cells.agg(*_cards())


def _by_each(df: DataFrame, *aggs: Column) -> DataFrame:
    """slicer, value and `aggs` for every value of every slicer, in one pass by grouping sets."""
    df = df.withColumn("year", c("year").cast("string"))
    g = df.groupingSets([[s] for s in SLICERS], *SLICERS).agg(F.grouping_id().alias("_gid"), *aggs)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(SLICERS):
        here = c("_gid") == (1 << len(SLICERS)) - 1 - (1 << (len(SLICERS) - 1 - i))
        name, value = F.when(here, F.lit(s)).otherwise(name), F.when(here, c(s)).otherwise(value)
    rest = [x for x in g.columns if x not in (*SLICERS, "_gid")]
    return g.select(name.alias("slicer"), value.alias("value"), *rest)


def slicer_cards(cells: DataFrame) -> DataFrame:
    """slicer, value and the cards of every single slicer value, merged from the cells."""
    return _by_each(cells, *_cards())


def sketch_check(cells: DataFrame, df: DataFrame, r: Roles = DEFAULT, lg_k: int = LG_K) -> DataFrame:
    """slicer, value, num_events, total_laid_off, avg_layoff_rate (from the cells), exact_companies (from the events),
    within_bound: the merged distinct count is within `error_bound` of the exact one."""
    rows = df.select(year_of(r).alias("year"), c(r.country).alias("country"), c(r.industry).alias("industry"),
                     c(r.stage).alias("stage"), c(r.company).alias("_company"))
    exact = _by_each(rows, F.countDistinct("_company").alias("exact_companies")).withColumnsRenamed({"slicer": "_s", "value": "_v"})
    both = slicer_cards(cells).join(exact, (c("slicer") == c("_s")) & c("value").eqNullSafe(c("_v")))
    off = F.abs(c("num_companies") - c("exact_companies"))
    return both.select("slicer", "value", "num_events", "total_laid_off", "avg_layoff_rate", "exact_companies",
                       (off <= F.ceil(c("exact_companies") * F.lit(error_bound(lg_k)))).alias("within_bound"))
