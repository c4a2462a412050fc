"""Event tables derived from the driver's star-schema parquet tables.

`fact_view` is the typed event table (roles as in `Roles()`), `raw_view` the
same events as messy all-string landing rows. Both are lazy DataFrames over
``orders ⋈ customer ⋈ nation ⋈ region``. No hint forces a broadcast of
``customer``: at scale it is large, and Spark picks broadcast or sort-merge
from its size estimate; nation and region are always tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Read schemas of the driver tables (the columns the views use). Declaring
# them skips Spark's footer-reading schema inference job on every read.
TABLE_SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # The fact table streams through the joins. Spark broadcasts a side only
    # when its size estimate is under spark.sql.autoBroadcastJoinThreshold
    # (customer at small scale, nation/region always); otherwise the
    # orders-customer join is a sort-merge join (AQE splits skewed keys).
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))


def _null_unless(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def fact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed event table: one row per order.

    company = customer name; company_group = 'Company <custkey % 300>' (an
    entity spanning countries and industries); location = nation; country =
    region; industry = market segment; stage = priority ('Unknown' for the
    unspecified one); date = order date; total_laid_off / percentage_laid_off /
    funds_raised_millions carry deterministic NULLs; total_skewed is a heavily
    right-skewed measure for the outlier and segmentation operators;
    event_id = order key (tie-break).
    """
    e = _events(spark, sf_dir)
    k = F.col("o_orderkey")
    u = F.col("o_totalprice") / F.lit(50000.0)
    return e.select(
        k.alias("event_id"),
        F.col("c_name").alias("company"),
        F.concat(F.lit("Company "), (F.col("o_custkey") % 300).cast("string")).alias("company_group"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("country"),
        F.col("c_mktsegment").alias("industry"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Unknown"))
         .otherwise(F.col("o_orderpriority")).alias("stage"),
        F.col("o_orderdate").cast("date").alias("date"),
        _null_unless(k % 7 == 0, F.floor(F.col("o_totalprice") / 100).cast("int")).alias("total_laid_off"),
        _null_unless(k % 5 == 0, (k % 21) / F.lit(20.0)).alias("percentage_laid_off"),
        _null_unless(k % 11 == 0, F.round(F.col("c_acctbal") + 1000, 2)).alias("funds_raised_millions"),
        _null_unless(k % 7 == 0, F.floor(u * u * u * u * u * u * u * u / F.lit(10000.0)).cast("int"))
        .alias("total_skewed"),
    )


RAW_COLUMNS = ("company", "location", "industry", "total_laid_off", "percentage_laid_off",
               "date", "stage", "country", "funds_raised_millions")


def raw_view(spark: SparkSession, sf_dir: str, unknown_group: int | None = None,
             copy_column: str | None = None) -> DataFrame:
    """Messy landing rows (all strings), as a delimited file would deliver them.

    Outer spaces on company, 'NULL' tokens and real NULLs, two spellings of a
    collapsible category, 'United States.' with a trailing dot, padded country
    names, numbers followed by a no-break space and a carriage return, junk
    dates and numbers, company names over 50 characters, and every tenth event
    delivered twice. ``unknown_group`` makes one company
    group industry-less so imputation cannot fill it. ``copy_column`` keeps
    the delivery number (1, or 2 for the repeated copy) under that name.
    """
    e = _events(spark, sf_dir)
    k = F.col("o_orderkey")
    grp = F.concat(F.lit("Company "), (F.col("o_custkey") % 300).cast("string"))
    seg = F.col("c_mktsegment")
    industry = (F.when(k % 13 == 0, F.lit("NULL"))
                 .when(k % 17 == 0, F.lit(None))
                 .when(seg == "MACHINERY",
                       F.when(k % 2 == 0, F.lit("Crypto Currency")).otherwise(F.lit("CryptoCurrency")))
                 .otherwise(seg))
    if unknown_group is not None:
        industry = F.when(F.col("o_custkey") % 300 == unknown_group, F.lit(None)).otherwise(industry)
    cr, nbsp = F.lit("\r"), F.lit("\u00a0")
    rows = e.select(
        F.when(k % 59 == 0, F.concat(grp, F.lit(" " + "of a very long name" * 3)))
         .when(k % 3 == 0, F.concat(F.lit("  "), grp, F.lit(" "))).otherwise(grp).alias("company"),
        F.col("n_name").alias("location"),
        industry.cast("string").alias("industry"),
        F.when(k % 7 == 0, F.lit("NULL")).when(k % 47 == 0, F.lit("12.5")).when(k % 53 == 0, F.lit("n/a"))
         .otherwise(F.floor(F.col("o_totalprice") / 100).cast("int").cast("string")).alias("total_laid_off"),
        F.when(k % 5 == 0, F.lit("NULL")).when(k % 61 == 0, F.lit("ten%"))
         .otherwise(((k % 21) / F.lit(20.0)).cast("string")).alias("percentage_laid_off"),
        F.when(k % 19 == 0, F.lit("NULL")).when(k % 37 == 0, F.lit("13/45/2023")).when(k % 43 == 0, F.lit("2023-03-06"))
         .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("NULL"))
         .otherwise(F.col("o_orderpriority")).alias("stage"),
        F.when(F.col("n_regionkey") == 0,
               F.when(k % 4 == 0, F.lit("United States.")).otherwise(F.lit("United States")))
         .otherwise(F.concat(F.lit(" "), F.col("r_name"), F.lit("  "))).alias("country"),
        F.when(k % 11 == 0, F.concat(F.lit("NULL"), cr))
         .otherwise(F.concat(F.floor(F.col("c_acctbal") + 1000).cast("long").cast("string"), nbsp, cr))
         .alias("funds_raised_millions"),
        # every tenth event is delivered twice: a narrow explode, no second scan
        F.explode(F.sequence(F.lit(1), F.when(k % 10 == 0, F.lit(2)).otherwise(F.lit(1)))).alias("_copy"),
    )
    return rows.withColumnRenamed("_copy", copy_column) if copy_column else rows.drop("_copy")


def short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing lines with two fields only (every 29th event): malformed for the nine-column schema."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 29 == 0)
    return o.select(F.concat(F.lit("Short "), F.col("o_orderkey").cast("string")).alias("company"), F.lit("Row").alias("location"))


# Nations of the driver's tables as places of the geographic lookups; the first
# four carry a map atlas's country name, which the event tables do not use.
PLACES = {
    "UNITED STATES": ("United States of America", "Seattle"), "RUSSIA": ("Russian Federation", "Moscow"),
    "IRAN": ("Iran (Islamic Republic of)", "Tehran"), "UNITED KINGDOM": ("United Kingdom", "London"),
    "ARGENTINA": ("Argentina", "Buenos Aires"), "BRAZIL": ("Brazil", "Sao Paulo"), "CANADA": ("Canada", "Toronto"),
    "CHINA": ("China", "Beijing"), "FRANCE": ("France", "Paris"), "GERMANY": ("Germany", "Berlin"),
    "INDIA": ("India", "Bengaluru"), "INDONESIA": ("Indonesia", "Jakarta"), "KENYA": ("Kenya", "Nairobi"),
}


def place_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`fact_view` with country and location in the terms of the lookups (PLACES); other nations keep region and nation."""
    f = fact_view(spark, sf_dir)
    country, city = F.col("country"), F.col("location")
    for nation, (a, b) in PLACES.items():
        at = F.col("location") == nation
        country, city = F.when(at, F.lit(a)).otherwise(country), F.when(at, F.lit(b)).otherwise(city)
    return f.withColumns({"country": country, "location": city})
