"""Cleaning: landing strings -> typed, deduplicated, imputed event table.

The whole chain is one lazy plan:
  exact dedup (one hash aggregate; map-side combine collapses a hot group of
  copies inside each task) -> narrow per-row projection -> optional length
  check (rows over it are rejects, a frame of their own) -> drop uninformative
  rows -> peer imputation of the rows that lack a value (the others pass
  untouched) -> label the rest.
No row leaves without a name: every landing row is a duplicate, malformed, a
reject, uninformative or clean, and `load_audit` counts each. Nothing is
collected; the caller writes the result once (see plans.sinks, plans.jobs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collapse, null_token, strip_chars, token_to_label
from ..functions import strip_suffix_on_prefix as suffix_expr
from ..functions.text import COLLAPSE_RULES, COUNTRY_PREFIX, NULL_TOKEN, UNKNOWN
from ..roles import DEFAULT, Roles
from ..sources.fixtures import RAW_COLUMNS
from ._common import held

def finite(value, dtype: str = "double"):
    """NULL instead of an infinite value or NaN."""
    return F.when(F.abs(value) < F.lit(float("inf")), value) if dtype in ("double", "float") else value


DATE_FORMAT = "M/d/yyyy"  # month/day/year; one- or two-digit month and day


def exact_dedup(df: DataFrame, cols=None) -> DataFrame:
    """Keep one row per identical tuple of ``cols`` (all columns by default).

    NULLs compare equal. Planned as a hash aggregate with partial
    aggregation, so many copies of one row are merged before the shuffle.
    """
    return df.dropDuplicates(list(cols) if cols else None)


#: Collations with a text of their own for equal values: comparing these by hash needs no comparison under the collation.
FOLDS = {"UTF8_LCASE": lambda x: F.lower(x), "UTF8_LCASE_RTRIM": lambda x: F.lower(F.rtrim(x))}


def folded_dedup(df: DataFrame, fold, cols) -> DataFrame:
    """Keep one row per tuple of ``cols`` whose texts are equal after ``fold`` (any of their spellings stays)."""
    keys = {f"_fold{i}": fold(F.col(x)) for i, x in enumerate(cols)}
    rest = [x for x in df.columns if x not in cols]
    return df.withColumns(keys).dropDuplicates([*keys, *rest]).drop(*keys)


def trim_text(df: DataFrame, cols=("company",)) -> DataFrame:
    """Strip outer spaces (only U+0020, like SQL TRIM)."""
    return df.withColumns({c: F.trim(F.col(c)) for c in cols})


def strip_suffix_on_prefix(df: DataFrame, col: str = "country", prefix: str = COUNTRY_PREFIX,
                           chars: str = ".") -> DataFrame:
    """Values starting with ``prefix`` lose trailing ``chars``; others are trimmed."""
    return df.withColumn(col, suffix_expr(col, prefix, chars))


def collapse_category(df: DataFrame, col: str = "industry", rules=None) -> DataFrame:
    """Values starting with a rule prefix (case-insensitive) become its label."""
    return df.withColumn(col, collapse(col, COLLAPSE_RULES if rules is None else rules))


def null_token_to_null(df: DataFrame, col: str = "industry", tokens=(NULL_TOKEN,)) -> DataFrame:
    """A literal null token (any case) becomes a real NULL."""
    return df.withColumn(col, null_token(col, tokens))


def null_token_to_label(df: DataFrame, col: str = "stage", label: str = UNKNOWN,
                        tokens=(NULL_TOKEN,)) -> DataFrame:
    """A literal null token becomes ``label``; a real NULL stays NULL."""
    return df.withColumn(col, token_to_label(col, label, tokens))


def safe_date(df: DataFrame, col: str = "date", fmt: str = DATE_FORMAT) -> DataFrame:
    """Text date -> DATE, NULL when it does not parse (never fails the job)."""
    return df.withColumn(col, F.try_to_date(F.col(col), fmt))


def safe_numeric(df: DataFrame, col: str, dtype: str) -> DataFrame:
    """Text -> numeric type, NULL on junk. '12.0' is not an integer; texts of
    infinite values or NaN are junk, as in a database without them."""
    return df.withColumn(col, finite(F.col(col).try_cast(dtype), dtype))


def strip_invisible_numeric(df: DataFrame, col: str = "funds_raised_millions", scale: int = 2) -> DataFrame:
    """Remove no-break spaces, CR and LF, cast to double (NULL on junk, infinite values and NaN), round to ``scale``."""
    return df.withColumn(col, F.round(finite(strip_chars(col).try_cast("double")), scale))


def drop_uninformative(df: DataFrame, cols=("total_laid_off", "percentage_laid_off")) -> DataFrame:
    """Drop rows where every listed measure is NULL."""
    return df.na.drop(how="all", subset=list(cols))


def impute_from_peer(df: DataFrame, key: str = "company", attr: str = "industry",
                     strategy: str = "min", fold=None) -> DataFrame:
    """Fill a NULL ``attr`` from other rows of the same ``key``.

    The donor value per key is its smallest (``min``) or most frequent
    (``mode``, smallest on ties) non-NULL value. Donors come from a hash count
    per (key, value), combined map-side, so a hot key is small before any
    shuffle; a rank over those pairs picks one. Only rows that lack the value
    and have a key are joined; rows with a value, and rows without a key, are
    passed through without a shuffle. With ``fold``, keys and values are equal
    if their folded texts are.
    """
    same = fold or (lambda x: x)
    rank = {"min": (F.col("_same"),), "mode": (F.desc("_n"), F.col("_same"))}
    if strategy not in rank:
        raise ValueError(f"unknown strategy {strategy!r}")
    lacks = F.col(attr).isNull() & F.col(key).isNotNull()
    pairs = df.filter(F.col(attr).isNotNull() & F.col(key).isNotNull()).groupBy(same(F.col(key)).alias("_of"), same(F.col(attr)).alias("_same"), F.col(attr).alias("_donor")).agg(F.count(F.lit(1)).alias("_n"))
    if fold:  # spellings of one value: the smallest one stands for them
        pairs = pairs.groupBy("_of", "_same").agg(F.sum("_n").alias("_n"), F.min("_donor").alias("_donor"))
    first = F.row_number().over(Window.partitionBy("_of").orderBy(*rank[strategy]))
    donors = pairs.withColumn("_rank", first).filter(F.col("_rank") == 1).select("_of", "_donor")
    filled = df.filter(lacks).join(donors, same(F.col(key)) == F.col("_of"), "left").withColumn(attr, F.col("_donor")).select(*df.columns)
    return df.filter(~lacks).unionByName(filled)


def label_unknown(df: DataFrame, col: str = "industry", label: str = UNKNOWN) -> DataFrame:
    """Remaining NULLs -> ``label``."""
    return df.fillna(label, subset=[col])


def typed_projection(raw: DataFrame, r: Roles = DEFAULT, date_format: str = DATE_FORMAT, extra=()) -> DataFrame:
    """All per-row rules in one narrow projection, in the clean column order; ``extra`` columns follow as they are."""
    return raw.select(
        F.trim(F.col("company")).alias(r.company),
        F.col("location").alias(r.location),
        suffix_expr("country").alias(r.country),
        null_token(collapse("industry")).alias(r.industry),
        token_to_label("stage").alias(r.stage),
        F.try_to_date(F.col("date"), date_format).alias(r.date),
        F.col("total_laid_off").try_cast("int").alias(r.total),
        finite(F.col("percentage_laid_off").try_cast("double")).alias(r.pct),
        F.round(finite(strip_chars("funds_raised_millions").try_cast("double")), 2).alias(r.funds),
        *extra,
    )


def too_long(r: Roles, max_len: int):
    """Some text column has more than ``max_len`` characters."""
    cond = F.lit(False)
    for c in (r.company, r.location, r.country, r.industry, r.stage):
        cond = cond | (F.coalesce(F.length(F.col(c)), F.lit(0)) > max_len)
    return cond


def clean_stages(raw: DataFrame, r: Roles = DEFAULT, max_len: int | None = None,
                 dedup_after: bool = False, strategy: str = "min",
                 collation: str | None = None, corrupt_col: str | None = None) -> dict[str, DataFrame]:
    """Every intermediate stage of `clean_events`, by name (all lazy).

    ``corrupt_col`` names the reader's corrupt-record column, if the landing
    rows carry it: malformed rows are the stage ``malformed`` and take no part
    in the others. With ``max_len``, rows with a longer text value are the
    stage ``rejects``; without it there are none. ``uninformative`` holds the
    rows without any measure.

    ``collation`` (e.g. "UTF8_LCASE_RTRIM": case-insensitive, trailing spaces
    ignored, like the source database's default) makes dedup, token tests and
    the imputation join compare text under that collation; the clean output is
    cast back to plain strings.
    """
    malformed = None
    if corrupt_col:
        # The reader refuses a scan that needs only its corrupt-record column,
        # so the predicate also reads the parsed fields.
        seen = F.length(F.concat_ws("|", F.col(corrupt_col), *[F.col(c) for c in RAW_COLUMNS])) >= 0
        malformed = raw.filter(F.col(corrupt_col).isNotNull() & seen)
        raw = raw.filter(F.col(corrupt_col).isNull())
    raw = raw.select(*RAW_COLUMNS)
    text, fold = (r.company, r.location, r.country, r.industry, r.stage), FOLDS.get(collation)
    collate = lambda df, cols: df.withColumns({x: F.collate(F.col(x), collation) for x in cols}) if collation else df
    dedup = (lambda df, cols: folded_dedup(df, fold, cols)) if fold else (lambda df, cols: exact_dedup(collate(df, cols)))
    deduped = raw if dedup_after else dedup(raw, RAW_COLUMNS)
    typed = typed_projection(collate(deduped, RAW_COLUMNS), r)
    if fold:  # the rules above compared under the collation; from here on folded texts do
        typed = typed.withColumns({x: F.col(x).cast("string") for x in text})
    if dedup_after:
        typed = dedup(typed, text)
    over = F.lit(False) if max_len is None else too_long(r, max_len)
    fits = typed if max_len is None else typed.filter(~over)
    # donors, rows to fill and rows that pass all read these: one exchange, one scan
    informative = held(drop_uninformative(fits, (r.total, r.pct)))
    imputed = impute_from_peer(informative, r.company, r.industry, strategy, fold)
    clean = label_unknown(imputed, r.industry)
    if collation and not fold:
        clean = clean.select(*[F.col(x).cast("string").alias(x) if x in text else F.col(x) for x in clean.columns])
    out = {"raw": raw, "distinct": deduped, "typed": typed, "rejects": typed.filter(over),
           "uninformative": fits.filter(F.col(r.total).isNull() & F.col(r.pct).isNull()),
           "informative": informative, "clean": clean}
    return out if malformed is None else {**out, "malformed": malformed}


def clean_events(raw: DataFrame, r: Roles = DEFAULT, dedup_after: bool = False, strategy: str = "min",
                 collation: str | None = None) -> DataFrame:
    """Landing rows -> clean event table (company, location, country, industry,
    stage, date, total_laid_off, percentage_laid_off, funds_raised_millions).

    Dedup runs on the raw strings first (rows equal only after trimming
    survive) unless ``dedup_after``; see `clean_stages` for ``collation``.
    Text of any length is kept. For a length limit use `clean_and_rejects`,
    which hands the rows over it back.
    """
    return clean_stages(raw, r, None, dedup_after, strategy, collation)["clean"]


def clean_and_rejects(raw: DataFrame, max_len: int, r: Roles = DEFAULT, **kw) -> tuple[DataFrame, DataFrame]:
    """(clean events, typed rows with a text value over ``max_len`` characters)."""
    st = clean_stages(raw, r, max_len, **kw)
    return st["clean"], st["rejects"]


def audit_counts(r: Roles, max_len: int | None) -> list:
    """The counts of `load_audit` over typed groups of equal landing rows (`_n` rows each, `_bad` if malformed)."""
    over = F.lit(False) if max_len is None else too_long(r, max_len)
    measured = F.col(r.total).isNotNull() | F.col(r.pct).isNotNull()
    ok, n = ~F.col("_bad"), F.col("_n")
    one = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    return [one(F.lit(True), n).alias("raw"), one(F.col("_bad"), n).alias("malformed"), one(ok, n - 1).alias("duplicates"),
            one(ok, F.lit(1)).alias("distinct"), one(ok & over, F.lit(1)).alias("rejects"),
            one(ok & ~over & ~measured, F.lit(1)).alias("uninformative"), one(ok & ~over & measured, F.lit(1)).alias("clean")]


def staged_load(raw: DataFrame, r: Roles = DEFAULT, corrupt_col: str | None = None, max_len: int | None = None,
                collation: str | None = None):
    """(groups, observation): the landing rows as one typed row per distinct row, to be written once.

    Besides the typed columns a group has `_n` (how often it came), `_bad` and,
    if malformed, `_landing` (its fields and the corrupt record). The counts of
    `load_audit` are gathered as the groups are written (`Observation.get`
    afterwards), so the landing text is read once for table, rejects and audit.
    `from_staged` makes these from the written groups.
    """
    from pyspark.sql import Observation

    if collation and collation not in FOLDS:
        raise ValueError(f"a staged load knows the collations {sorted(FOLDS)}, not {collation}")
    same = FOLDS.get(collation)
    record = F.col(corrupt_col) if corrupt_col else F.lit(None).cast("string")
    rows = raw.select(*RAW_COLUMNS, record.alias("_record"))
    if same:
        keys = [same(F.col(x)).alias(f"_fold{i}") for i, x in enumerate(RAW_COLUMNS)]
        groups = rows.groupBy(*keys, "_record").agg(F.count(F.lit(1)).alias("_n"), *[F.first(x).alias(x) for x in RAW_COLUMNS])
        groups = groups.select(*[F.collate(F.col(x), collation).alias(x) for x in RAW_COLUMNS], "_record", "_n")
    else:
        groups = rows.groupBy(*RAW_COLUMNS, "_record").agg(F.count(F.lit(1)).alias("_n"))
    bad = F.col("_record").isNotNull()
    landing = F.when(bad, F.struct(*[F.col(x).cast("string").alias(x) for x in RAW_COLUMNS], F.col("_record")))
    groups = groups.select("*", bad.alias("_bad"), landing.alias("_landing"))
    obs = Observation("eventlens_load")
    typed = typed_projection(groups, r, extra=("_n", "_bad", "_landing"))
    if same:
        typed = typed.withColumns({x: F.col(x).cast("string") for x in (r.company, r.location, r.country, r.industry, r.stage)})
    return typed.observe(obs, *audit_counts(r, max_len)), obs


def from_staged(groups: DataFrame, r: Roles = DEFAULT, max_len: int | None = None, dedup_after: bool = False, strategy: str = "min",
                collation: str | None = None) -> dict[str, DataFrame]:
    """clean, rejects and malformed from the written groups of `staged_load`."""
    text = (r.company, r.location, r.country, r.industry, r.stage)
    good, fold = groups.filter(~F.col("_bad")).drop("_n", "_bad", "_landing"), FOLDS.get(collation)
    if dedup_after:
        good = folded_dedup(good, fold, text) if fold else exact_dedup(good)
    over = F.lit(False) if max_len is None else too_long(r, max_len)
    clean = drop_uninformative(good.filter(~over), (r.total, r.pct))
    clean = label_unknown(impute_from_peer(clean, r.company, r.industry, strategy, fold), r.industry)
    malformed = groups.filter("_bad").select("_landing.*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")
    return {"clean": clean, "rejects": good.filter(over), "malformed": malformed}


AUDIT_STAGES = ("raw", "malformed", "duplicates", "distinct", "rejects", "uninformative", "clean")


def load_audit(raw: DataFrame, r: Roles = DEFAULT, corrupt_col: str | None = None,
               max_len: int | None = None) -> DataFrame:
    """Row counts per stage: stage, num_rows, in the order of AUDIT_STAGES.

    raw (all landing rows), malformed (rows the reader could not split into
    the schema, if ``corrupt_col`` names its corrupt-record column), duplicates
    (further copies of well-formed rows), distinct, rejects (over ``max_len``),
    uninformative and clean. raw = malformed + duplicates + distinct, and
    distinct = rejects + uninformative + clean (imputation neither adds nor
    removes rows). One pass: the landing rows are grouped by their text with a
    count, and the groups are typed and counted.
    """
    bad = F.col(corrupt_col).isNotNull() if corrupt_col else F.lit(False)
    # malformed rows share one group: they are counted, not compared
    keys = [F.when(~bad, F.col(c)).alias(c) for c in RAW_COLUMNS]
    groups = raw.select(*keys, bad.alias("_bad")).groupBy(*RAW_COLUMNS, "_bad").agg(F.count(F.lit(1)).alias("_n"))
    typed = typed_projection(groups, r, extra=("_bad", "_n"))
    counts = typed.agg(*audit_counts(r, max_len))
    order = F.array(*[F.lit(s) for s in AUDIT_STAGES])
    return counts.unpivot([], list(AUDIT_STAGES), "stage", "num_rows").orderBy(F.array_position(order, F.col("stage")))


def clean_with_audit(raw: DataFrame, r: Roles = DEFAULT, corrupt_col: str | None = None, max_len: int | None = None, **kw):
    """The clean and reject frames with load metrics gathered as they are written.

    Returns (stages, observations). ``stages`` has clean, rejects and, with
    ``corrupt_col``, malformed. The observations fill when the first action
    runs on a frame (typically its one write): ``clean`` has rows,
    rows_with_date, rows_with_measure and unknown_industry, ``rejects`` and
    ``malformed`` have rows. The clean frame reads the landing rows in more
    than one branch, so they are counted by `load_audit`, not here.
    """
    from pyspark.sql import Observation

    obs = {name: Observation(f"eventlens_{name}") for name in ("clean", "rejects", "malformed")}
    st = clean_stages(raw, r, max_len, corrupt_col=corrupt_col, **kw)
    metrics = [F.count(F.lit(1)).alias("rows")]
    st["clean"] = st["clean"].observe(
        obs["clean"], F.count(F.lit(1)).alias("rows"),
        F.count(F.col(r.date)).alias("rows_with_date"),
        F.count(F.col(r.total)).alias("rows_with_measure"),
        F.count_if(F.col(r.industry) == UNKNOWN).alias("unknown_industry"))
    for name in ("rejects", "malformed"):
        if name in st:
            st[name] = st[name].observe(obs[name], *metrics)
    return st, obs
