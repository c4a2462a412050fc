"""Sinks: the clean event table and the map's nested export.

Writes are single overwrite actions of a lazy plan; a lost executor only
re-runs its tasks, and a failed job leaves the previous output folder to be
overwritten by the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import DEFAULT, Roles

YEAR_COLUMN = "event_year"


def write_event_table(df: DataFrame, path: str, r: Roles = DEFAULT, partition_by_year: bool = True) -> None:
    """Write a (clean) event table as parquet, partitioned by event year so
    year slicers prune whole folders. Rows with no date land in the
    ``event_year=__HIVE_DEFAULT_PARTITION__`` folder. Rows are clustered by year
    first (REBALANCE: Spark splits a large year and merges small ones), so a
    year has a few files, not one from every task."""
    w = df
    if partition_by_year:
        w = df.withColumn(YEAR_COLUMN, F.year(r.date)).hint("rebalance", YEAR_COLUMN)
        w.write.mode("overwrite").partitionBy(YEAR_COLUMN).parquet(path)
    else:
        w.write.mode("overwrite").parquet(path)


def export_city_map(city: DataFrame, path: str) -> None:
    """Nested map export: one JSON line per country with its cities as an
    array of structs (city, num_companies, total_laid_off, layoff_rate_raw,
    lat, lng). A country's list is bounded by its number of cities."""
    cols = [x for x in ("city", "num_companies", "total_laid_off", "layoff_rate_raw", "lat", "lng") if x in city.columns]
    nested = city.groupBy("country").agg(
        F.sort_array(F.collect_list(F.struct(F.col("total_laid_off").alias("_k"), *cols)), asc=False).alias("_c"))
    nested = nested.select("country", F.transform("_c", lambda s: s.dropFields("_k")).alias("cities"))
    nested.write.mode("overwrite").json(path)
