"""Independent SQL (DuckDB dialect) for every registered query.

The views are written out again in plain SQL from the fixture definitions,
not generated from the Spark plans, and results are reached by other means
than in the operators where there are any (remainders instead of shifted
division for rounding, arg_min / arg_max for first and last rows, counts of
larger cells for ranks, joins of totals for shares).
"""

from __future__ import annotations


def ratio(num: str, den: str, scale: int) -> str:
    """num / den to ``scale`` decimals, halves away from zero: the whole part, and one more unit if twice the remainder reaches the divisor."""
    p = 10 ** scale
    n, d = f"(CAST(({num}) AS HUGEINT) * {p})", f"CAST(({den}) AS HUGEINT)"
    whole = f"({n} // {d})"  # DuckDB's // truncates toward zero
    return (f"(CASE WHEN {d} <> 0 THEN CAST({whole} + CASE WHEN 2 * abs({n} - {whole} * {d}) >= abs({d}) "
            f"THEN sign({n}) * sign({d}) ELSE 0 END AS DOUBLE) / {float(p)!r} END)")


def pct(num: str, den: str, precision: int = 5, scale: int = 1) -> str:
    return f"CAST({ratio(f'CAST(({num}) AS BIGINT) * 100', den, scale)} AS DECIMAL({precision},{scale}))"


def int_avg(col: str) -> str:
    return f"(CASE WHEN count({col}) > 0 THEN CAST(sum({col}) AS BIGINT) // count({col}) END)"


def cents(col: str) -> str:
    return f"CAST(round({col} * 100.0) AS BIGINT)"


EVENTS = """
  orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""

F_VIEW = f"""F AS (
  SELECT
    o.o_orderkey AS event_id,
    c.c_name AS company,
    concat('Company ', CAST(o.o_custkey % 300 AS VARCHAR)) AS company_group,
    n.n_name AS location,
    r.r_name AS country,
    c.c_mktsegment AS industry,
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' ELSE o.o_orderpriority END AS stage,
    CAST(o.o_orderdate AS DATE) AS date,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice / 100) AS INTEGER) END AS total_laid_off,
    CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE (o.o_orderkey % 21) / CAST(20 AS DOUBLE) END AS percentage_laid_off,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE round(c.c_acctbal + 1000, 2) END AS funds_raised_millions,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(
      (o.o_totalprice / CAST(50000 AS DOUBLE)) * (o.o_totalprice / CAST(50000 AS DOUBLE))
      * (o.o_totalprice / CAST(50000 AS DOUBLE)) * (o.o_totalprice / CAST(50000 AS DOUBLE))
      * (o.o_totalprice / CAST(50000 AS DOUBLE)) * (o.o_totalprice / CAST(50000 AS DOUBLE))
      * (o.o_totalprice / CAST(50000 AS DOUBLE)) * (o.o_totalprice / CAST(50000 AS DOUBLE))
      / CAST(10000 AS DOUBLE)) AS INTEGER) END AS total_skewed
  FROM {EVENTS}
)"""

# The fact view with the skewed measure in the measure role.
FS_VIEW = """FS AS (
  SELECT event_id, company, company_group, location, country, industry, stage, date,
         total_skewed AS total_laid_off, percentage_laid_off, funds_raised_millions
  FROM F
)"""

# The fact view with the multi-country entity in the company role.
FG_VIEW = """FG AS (
  SELECT event_id, company_group AS company, location, country, industry, stage, date,
         total_laid_off, percentage_laid_off, funds_raised_millions
  FROM F
)"""


def raw_view(unknown_group: int | None = None) -> str:
    industry = """CASE WHEN o.o_orderkey % 13 = 0 THEN 'NULL'
           WHEN o.o_orderkey % 17 = 0 THEN NULL
           WHEN c.c_mktsegment = 'MACHINERY' THEN
             CASE WHEN o.o_orderkey % 2 = 0 THEN 'Crypto Currency' ELSE 'CryptoCurrency' END
           ELSE c.c_mktsegment END"""
    if unknown_group is not None:
        industry = f"CASE WHEN o.o_custkey % 300 = {unknown_group} THEN NULL ELSE {industry} END"
    grp = "concat('Company ', CAST(o.o_custkey % 300 AS VARCHAR))"
    return f"""R AS (
  SELECT
    CASE WHEN o.o_orderkey % 59 = 0 THEN {grp} || ' ' || repeat('of a very long name', 3)
         WHEN o.o_orderkey % 3 = 0 THEN concat('  ', {grp}, ' ') ELSE {grp} END AS company,
    n.n_name AS location,
    {industry} AS industry,
    CASE WHEN o.o_orderkey % 7 = 0 THEN 'NULL' WHEN o.o_orderkey % 47 = 0 THEN '12.5' WHEN o.o_orderkey % 53 = 0 THEN 'n/a'
         ELSE CAST(CAST(floor(o.o_totalprice / 100) AS INTEGER) AS VARCHAR) END AS total_laid_off,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'NULL' WHEN o.o_orderkey % 61 = 0 THEN 'ten%'
         ELSE CAST((o.o_orderkey % 21) / CAST(20 AS DOUBLE) AS VARCHAR) END AS percentage_laid_off,
    CASE WHEN o.o_orderkey % 19 = 0 THEN 'NULL' WHEN o.o_orderkey % 37 = 0 THEN '13/45/2023' WHEN o.o_orderkey % 43 = 0 THEN '2023-03-06' ELSE strftime(o.o_orderdate, '%m/%d/%Y') END AS date,
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'NULL' ELSE o.o_orderpriority END AS stage,
    CASE WHEN n.n_regionkey = 0 THEN
           CASE WHEN o.o_orderkey % 4 = 0 THEN 'United States.' ELSE 'United States' END
         ELSE concat(' ', r.r_name, '  ') END AS country,
    CASE WHEN o.o_orderkey % 11 = 0 THEN concat('NULL', chr(13))
         ELSE concat(CAST(CAST(floor(c.c_acctbal + 1000) AS BIGINT) AS VARCHAR), chr(160), chr(13)) END
      AS funds_raised_millions,
    o.o_orderkey AS _k
  FROM {EVENTS}
), RR AS (
  SELECT company, location, industry, total_laid_off, percentage_laid_off, date, stage, country,
         funds_raised_millions FROM R
  UNION ALL
  SELECT company, location, industry, total_laid_off, percentage_laid_off, date, stage, country,
         funds_raised_millions FROM R WHERE _k % 10 = 0
)"""


def whole(col: str) -> str:
    """A whole number or NULL (DuckDB's own cast would round '12.5')."""
    return f"CASE WHEN regexp_full_match({col}, '[+-]?[0-9]+') THEN TRY_CAST({col} AS INTEGER) END"


# Typed projection of the landing rows (per-row cleaning rules).
TYPED_SELECT = f"""
    trim(company, ' ') AS company,
    location,
    CASE WHEN lower(country) LIKE 'united state%' THEN rtrim(country, '.') ELSE trim(country, ' ') END AS country,
    CASE WHEN lower(industry) LIKE 'crypto%' THEN 'Crypto'
         WHEN industry IS NULL OR upper(industry) = 'NULL' THEN NULL
         ELSE industry END AS industry,
    CASE WHEN upper(stage) = 'NULL' THEN 'Unknown' ELSE stage END AS stage,
    CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS date,
    {whole("total_laid_off")} AS total_laid_off,
    TRY_CAST(percentage_laid_off AS DOUBLE) AS percentage_laid_off,
    round(TRY_CAST(translate(funds_raised_millions, chr(160) || chr(13) || chr(10), '') AS DOUBLE), 2)
      AS funds_raised_millions"""

LEN_OK = " AND ".join(
    f"coalesce(length({col}), 0) <= 50" for col in ("company", "location", "country", "industry", "stage"))


def clean_views(unknown_group: int | None = None) -> str:
    """WITH-list: R/RR (landing), D (dedup), T (typed), K (kept), DON (donors), C (clean)."""
    return f"""{raw_view(unknown_group)},
D AS (SELECT DISTINCT * FROM RR),
T AS (SELECT {TYPED_SELECT} FROM D),
K AS (SELECT * FROM T WHERE NOT (total_laid_off IS NULL AND percentage_laid_off IS NULL)),
DON AS (SELECT company, min(industry) AS donor FROM K
        WHERE industry IS NOT NULL AND company IS NOT NULL GROUP BY company),
C AS (
  SELECT K.company, K.location, K.country, coalesce(K.industry, DON.donor, 'Unknown') AS industry,
         K.stage, K.date, K.total_laid_off, K.percentage_laid_off, K.funds_raised_millions
  FROM K LEFT JOIN DON ON K.company = DON.company
)"""


PLACE_VIEW = """PV AS (
  SELECT F.* REPLACE (coalesce(p.country, F.country) AS country, coalesce(p.city, F.location) AS location)
  FROM F LEFT JOIN (VALUES ('UNITED STATES', 'United States of America', 'Seattle'), ('RUSSIA', 'Russian Federation', 'Moscow'),
    ('IRAN', 'Iran (Islamic Republic of)', 'Tehran'), ('UNITED KINGDOM', 'United Kingdom', 'London'), ('ARGENTINA', 'Argentina', 'Buenos Aires'),
    ('BRAZIL', 'Brazil', 'Sao Paulo'), ('CANADA', 'Canada', 'Toronto'), ('CHINA', 'China', 'Beijing'), ('FRANCE', 'France', 'Paris'),
    ('GERMANY', 'Germany', 'Berlin'), ('INDIA', 'India', 'Bengaluru'), ('INDONESIA', 'Indonesia', 'Jakarta'), ('KENYA', 'Kenya', 'Nairobi')
  ) AS p(nation, country, city) ON F.location = p.nation
)"""


def with_f(body: str, *extra: str) -> str:
    views = [F_VIEW, *extra]
    return "WITH " + ",\n".join(views) + "\n" + body
