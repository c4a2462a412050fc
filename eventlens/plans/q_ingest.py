"""Plans I1-I2 and C1-C13 (landing and cleaning) over the messy raw view."""

from __future__ import annotations

import hashlib
import time

from ..operators import clean as C
from ..session import scratch_path
from ..sources import CORRUPT, load_raw_csv, raw_view, short_rows, write_raw_csv
from ..sources.fixtures import RAW_COLUMNS
from . import oracle as O
from .registry import RAW, plan, with_clean

RAW_COLS = ", ".join(RAW_COLUMNS)


def with_raw(body: str, unknown_group: int | None = None) -> str:
    return "WITH " + O.raw_view(unknown_group) + "\n" + body


def landed_csv(spark, d, query, malformed=False):
    """Write the raw view as a CRLF-terminated CSV folder in the shared scratch
    folder and return its path. The folder belongs to the query and the
    driver's folder `d`, and each call writes it again. ``malformed`` adds a folder of lines
    with too few fields and returns both paths."""
    tag = hashlib.sha1(d.rstrip("/").encode()).hexdigest()[:12]
    path = scratch_path(spark, "landing", query, tag, "rows")
    write_raw_csv(RAW(spark, d), path)
    if not malformed:
        return path
    short = scratch_path(spark, "landing", query, tag, "short")
    write_raw_csv(short_rows(spark, d), short)
    return [path, short]


@plan("load_raw_csv", with_raw(f"SELECT {RAW_COLS} FROM RR"))
def load_raw(spark, d):
    return load_raw_csv(spark, landed_csv(spark, d, "load_raw_csv"))


@plan("load_audit", with_clean(f"""
, S AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 29 = 0),
LONG_ROWS AS (SELECT count(*) AS n FROM T WHERE NOT ({O.LEN_OK})),
EMPTY_ROWS AS (SELECT count(*) AS n FROM T WHERE {O.LEN_OK} AND total_laid_off IS NULL AND percentage_laid_off IS NULL)
SELECT 'raw' AS stage, (SELECT count(*) FROM RR) + (SELECT n FROM S) AS num_rows
UNION ALL SELECT 'malformed', n FROM S
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM RR) - (SELECT count(*) FROM D)
UNION ALL SELECT 'distinct', count(*) FROM D
UNION ALL SELECT 'rejects', n FROM LONG_ROWS
UNION ALL SELECT 'uninformative', n FROM EMPTY_ROWS
UNION ALL SELECT 'clean', (SELECT count(*) FROM D) - (SELECT n FROM LONG_ROWS) - (SELECT n FROM EMPTY_ROWS)"""))
def load_audit(spark, d):
    raw = load_raw_csv(spark, landed_csv(spark, d, "load_audit", malformed=True), keep_corrupt=True)
    return C.load_audit(raw, corrupt_col=CORRUPT, max_len=50)


@plan("clean_rejects", with_clean(f"SELECT * FROM T WHERE NOT ({O.LEN_OK})"))
def clean_rejects(spark, d):
    return C.clean_and_rejects(RAW(spark, d), 50)[1]


@plan("exact_dedup", with_raw(f"SELECT DISTINCT {RAW_COLS} FROM RR"))
def exact_dedup(spark, d):
    return C.exact_dedup(RAW(spark, d))


def _raw_with(expr_sql: str, col: str) -> str:
    cols = ", ".join(expr_sql if x == col else x for x in RAW_COLUMNS)
    return with_raw(f"SELECT {cols} FROM RR")


@plan("trim_text", _raw_with("trim(company, ' ') AS company", "company"))
def trim_text(spark, d):
    return C.trim_text(RAW(spark, d), ("company",))


@plan("strip_suffix_on_prefix", _raw_with(
    "CASE WHEN lower(country) LIKE 'united state%' THEN rtrim(country, '.') ELSE trim(country, ' ') END AS country",
    "country"))
def strip_suffix_on_prefix(spark, d):
    return C.strip_suffix_on_prefix(RAW(spark, d), "country")


@plan("collapse_category", _raw_with(
    "CASE WHEN lower(industry) LIKE 'crypto%' THEN 'Crypto' ELSE industry END AS industry", "industry"))
def collapse_category(spark, d):
    return C.collapse_category(RAW(spark, d), "industry")


@plan("null_token_to_null", _raw_with(
    "CASE WHEN industry IS NULL OR upper(industry) = 'NULL' THEN NULL ELSE industry END AS industry", "industry"))
def null_token_to_null(spark, d):
    return C.null_token_to_null(RAW(spark, d), "industry")


@plan("null_token_to_label", _raw_with(
    "CASE WHEN upper(stage) = 'NULL' THEN 'Unknown' ELSE stage END AS stage", "stage"))
def null_token_to_label(spark, d):
    return C.null_token_to_label(RAW(spark, d), "stage")


@plan("safe_date", _raw_with("CAST(try_strptime(date, '%m/%d/%Y') AS DATE) AS date", "date"))
def safe_date(spark, d):
    return C.safe_date(RAW(spark, d), "date")


@plan("safe_numeric", with_raw(", ".join(
    {"total_laid_off": O.whole("total_laid_off") + " AS total_laid_off",
     "percentage_laid_off": "TRY_CAST(percentage_laid_off AS DOUBLE) AS percentage_laid_off"}.get(x, x)
    for x in RAW_COLUMNS).join(["SELECT ", " FROM RR"])))
def safe_numeric(spark, d):
    df = C.safe_numeric(RAW(spark, d), "total_laid_off", "int")
    return C.safe_numeric(df, "percentage_laid_off", "double")


@plan("strip_invisible_numeric", _raw_with(
    "round(TRY_CAST(translate(funds_raised_millions, chr(160) || chr(13) || chr(10), '') AS DOUBLE), 2)"
    " AS funds_raised_millions", "funds_raised_millions"))
def strip_invisible_numeric(spark, d):
    return C.strip_invisible_numeric(RAW(spark, d), "funds_raised_millions")


@plan("drop_uninformative", with_clean(
    "SELECT * FROM T WHERE NOT (total_laid_off IS NULL AND percentage_laid_off IS NULL)"))
def drop_uninformative(spark, d):
    typed = C.typed_projection(C.exact_dedup(RAW(spark, d)))
    return C.drop_uninformative(typed)


@plan("impute_from_peer", with_clean("""
SELECT K.company, K.location, K.country, coalesce(K.industry, DON.donor) AS industry, K.stage, K.date,
       K.total_laid_off, K.percentage_laid_off, K.funds_raised_millions
FROM K LEFT JOIN DON ON K.company = DON.company"""))
def impute_from_peer(spark, d):
    return C.clean_stages(RAW(spark, d))["informative"].transform(
        lambda df: C.impute_from_peer(df, "company", "industry", "min"))


@plan("label_unknown", with_clean("SELECT * FROM C", unknown_group=7))
def label_unknown(spark, d):
    return C.clean_events(RAW(spark, d, unknown_group=7))


@plan("clean_events", with_clean("SELECT * FROM C"))
def clean_events(spark, d):
    return C.clean_events(RAW(spark, d))


# Case-insensitive cleaning, blind to trailing spaces: rows with an even length of company name are delivered again in capitals
# and with trailing spaces. Texts are shown in lower case, because any spelling may stand for its group.
_TEXT = ("company", "location", "country", "industry", "stage")
CLEAN_COLUMNS = (*_TEXT, "date", "total_laid_off", "percentage_laid_off", "funds_raised_millions")
_FOLD = ", ".join(f"lower(rtrim({x}, ' ')) AS {x}" for x in RAW_COLUMNS)
_AGAIN = ", ".join({"company": "upper(company)", "location": "upper(location) || '  '", "stage": "lower(stage) || ' '"}.get(x, x) for x in RAW_COLUMNS)


@plan("clean_events_collated", with_raw("") + f"""
, R2 AS (SELECT {', '.join(RAW_COLUMNS)} FROM RR UNION ALL SELECT {_AGAIN} FROM RR WHERE length(company) % 2 = 0),
D2 AS (SELECT DISTINCT {_FOLD} FROM R2),
K2 AS (SELECT {', '.join(f"rtrim(lower({x}), ' ') AS {x}" if x in _TEXT else x for x in CLEAN_COLUMNS)} FROM (SELECT {O.TYPED_SELECT} FROM D2) T
       WHERE total_laid_off IS NOT NULL OR percentage_laid_off IS NOT NULL),
DON2 AS (SELECT company, min(industry) AS donor FROM K2 WHERE industry IS NOT NULL AND company IS NOT NULL GROUP BY company)
SELECT K2.* REPLACE (coalesce(K2.industry, donor, 'unknown') AS industry) FROM K2 LEFT JOIN DON2 ON K2.company = DON2.company""")
def clean_events_collated(spark, d):
    from pyspark.sql import functions as F

    raw = RAW(spark, d)
    again = raw.where("length(company) % 2 = 0").withColumns({
        "company": F.upper("company"), "location": F.concat(F.upper("location"), F.lit("  ")), "stage": F.concat(F.lower("stage"), F.lit(" "))})
    out = C.clean_events(raw.unionByName(again), collation="UTF8_LCASE_RTRIM")
    return out.withColumns({x: F.lower(F.rtrim(x)) for x in _TEXT})


# Imputation by the most frequent peer value (ties -> smallest value).
@plan("impute_mode", with_clean("""
, DM AS (SELECT company, mode() WITHIN GROUP (ORDER BY industry) AS donor FROM K
         WHERE industry IS NOT NULL AND company IS NOT NULL GROUP BY company)
SELECT K.company, K.location, K.country, coalesce(K.industry, DM.donor, 'Unknown') AS industry, K.stage, K.date,
       K.total_laid_off, K.percentage_laid_off, K.funds_raised_millions
FROM K LEFT JOIN DM ON K.company = DM.company""", unknown_group=7))
def impute_mode(spark, d):
    return C.clean_events(RAW(spark, d, unknown_group=7), strategy="mode")



# Incremental landing: the raw view arrives as two CSV drops (every tenth
# event's copy comes in the second drop); a file-source stream deduplicates
# across both with state, and the landed table is then finalised in batch.
@plan("incremental_landing", with_clean("SELECT * FROM C"))
def incremental_landing(spark, d):
    from pyspark.sql import functions as F

    from ..streaming import finalize_landed, start_landing

    tag = hashlib.sha1(("stream:" + d.rstrip("/")).encode()).hexdigest()[:12]
    base = scratch_path(spark, "streaming", tag, str(time.time_ns()))
    raw = raw_view(spark, d, copy_column="_drop")
    for i in (1, 2):
        write_raw_csv(raw.filter(F.col("_drop") == i).drop("_drop"), f"{base}/src/drop{i}")
    q = start_landing(spark, f"{base}/src/*", f"{base}/table", f"{base}/checkpoint")
    q.awaitTermination()
    return finalize_landed(spark, f"{base}/table")
