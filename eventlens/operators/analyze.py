"""Advanced analysis: pivots, repeated-event trajectories, cross matrices,
percentiles, size segments, z-scores and the screens built on them.

Scale notes
* Per-entity trajectories (`multi_round`) use grouped min/max (and min_by/max_by)
  of a fixed-width ordering key (date and tie-break packed into one decimal),
  which aggregate by hash with map-side combine, instead of ROW_NUMBER windows
  over raw rows.
* Percentiles come from `quantiles`: exact, with bounded state in every task.
* Segment statistics have at most two rows; joining them back to every event
  uses a broadcast whose size is bounded by the number of segment labels.
* Windows only ever run over aggregated frames (stages, industries,
  countries, years), never over raw events.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import direction, int_avg, pct_ratio, percent, ratio, scaled, segment, severity, trend
from ..functions.labels import SEGMENT_THRESHOLD, SEVERITY_LABELS, TREND_LABELS
from ..roles import DEFAULT, Roles
from ._common import c, excluding, not_null, one_plan, ordered, whole, year_of
from .quantiles import quantiles

UNKNOWN = "Unknown"
QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.99)
QUANTILE_NAMES = ("Q1", "median", "Q3", "P90", "P99")


# --------------------------------------------------------------------------- A1


def pivot_share(df: DataFrame, r: Roles = DEFAULT, rows: str = "stage", years=None,
                exclude=UNKNOWN, order: bool = True) -> DataFrame:
    """Stage x year pivot: per year the total (``y<year>``) and its share of that
    year (``y<year>_pct``, DECIMAL(5,1)), ``grand_total`` over all years and
    ``total_pct``. An empty cell is 0.

    ``years`` defaults to the distinct years present (a short, calendar-bounded
    list fetched with one small job); pass them to avoid that job. Years not
    listed still count in ``grand_total``. One aggregate with conditional sums.
    """
    row_col = getattr(r, rows, rows)
    f = df.filter(excluding(row_col, exclude) & not_null(r.total, r.date))
    yr = year_of(r)
    if years is None:
        years = [x[0] for x in f.select(yr.alias("y")).distinct().orderBy("y").collect()]
    g = f.groupBy(c(row_col).alias(rows)).agg(
        *[F.sum(F.when(yr == y, c(r.total)).otherwise(0)).cast("long").alias(f"y{y}") for y in years],
        F.sum(r.total).cast("long").alias("grand_total"))
    cols = [c(rows)]
    for y in years:
        cols += [c(f"y{y}"), pct_ratio(f"y{y}", F.sum(f"y{y}").over(whole())).alias(f"y{y}_pct")]
    cols += [c("grand_total"), pct_ratio("grand_total", F.sum("grand_total").over(whole())).alias("total_pct")]
    return ordered(g.select(*cols), order, F.desc("grand_total"), rows)


def pivot_shift(pivot: DataFrame, y0: int, y1: int, rows: str = "stage") -> DataFrame:
    """From a `pivot_share` result: change of each row's share between two years
    (percentage points) and its concentration in a single year.

    rows, y<y0>_pct, y<y1>_pct, share_shift_pp, peak_year (earliest on ties),
    peak_year_share_pct (peak year's total as a percent of the row's grand total).
    """
    years = sorted(int(x[1:]) for x in pivot.columns if re.fullmatch(r"y\d{4}", x))
    top = F.greatest(*[c(f"y{y}") for y in years]) if len(years) > 1 else c(f"y{years[0]}")
    peak = None
    for y in years:
        cond = c(f"y{y}") == top
        peak = F.when(cond, F.lit(y)) if peak is None else peak.when(cond, F.lit(y))
    return pivot.select(
        rows, f"y{y0}_pct", f"y{y1}_pct",
        (c(f"y{y1}_pct") - c(f"y{y0}_pct")).cast("decimal(6,1)").alias("share_shift_pp"),
        peak.alias("peak_year"),
        pct_ratio(top, "grand_total").alias("peak_year_share_pct"))


def share_long(df: DataFrame, r: Roles = DEFAULT, rows: str = "stage", exclude=UNKNOWN, order: bool = True) -> DataFrame:
    """`pivot_share` in long form, for whatever years there are: stage, year,
    total, share_pct (of the year, DECIMAL(5,1)), grand_total (of the stage),
    total_pct. One row per stage and year with events; no job lists the years."""
    key = getattr(r, rows, rows)
    f = df.filter(excluding(key, exclude) & not_null(r.total, r.date))
    g = f.groupBy(c(key).alias(rows), year_of(r).alias("year")).agg(F.sum(r.total).cast("long").alias("total"))
    out = g.select(rows, "year", "total", pct_ratio("total", F.sum("total").over(Window.partitionBy("year"))).alias("share_pct"),
                   F.sum("total").over(Window.partitionBy(rows)).cast("long").alias("grand_total"), F.sum("total").over(whole()).alias("_all"))
    out = out.select(rows, "year", "total", "share_pct", "grand_total", pct_ratio("grand_total", "_all").alias("total_pct"))
    return ordered(out, order, rows, "year")


def shift_long(df: DataFrame, r: Roles = DEFAULT, rows: str = "stage", exclude=UNKNOWN, order: bool = True) -> DataFrame:
    """Per row of the pivot: first_year and last_year of the data with their
    shares, share_shift_pp between them, peak_year (largest total, earliest on
    ties) and peak_year_share_pct (percent of the row's grand total)."""
    g = share_long(df, r, rows, exclude, order=False)
    ends = g.select("*", F.min("year").over(whole()).alias("first_year"), F.max("year").over(whole()).alias("last_year"),
                    F.max("total").over(Window.partitionBy(rows)).alias("_top"))
    share = lambda y: F.coalesce(F.max(F.when(c("year") == c(y), c("share_pct"))), F.lit(0).cast("decimal(5,1)"))
    out = ends.groupBy(rows, "first_year", "last_year", "grand_total").agg(
        share("first_year").alias("first_share_pct"), share("last_year").alias("last_share_pct"),
        F.min(F.when(c("total") == c("_top"), c("year"))).alias("peak_year"), F.max("_top").alias("_top"))
    out = out.select(rows, "first_year", "last_year", "first_share_pct", "last_share_pct",
                     (c("last_share_pct") - c("first_share_pct")).cast("decimal(6,1)").alias("share_shift_pp"), "peak_year",
                     pct_ratio("_top", "grand_total").alias("peak_year_share_pct"))
    return ordered(out, order, rows)


# --------------------------------------------------------------------------- A2


def _order_key(df: DataFrame, date: str, tie_break) -> Column:
    """Date and up to one 64-bit tie-break as one decimal, so that min and max keep a fixed-width buffer."""
    if len(tie_break) != 1 or not isinstance(df.schema[tie_break[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"the tie-break must be one integer column, not {tie_break}")
    day = F.unix_date(c(date).cast("date")).cast("decimal(10,0)")
    return day * F.lit("1" + "0" * 20).cast("decimal(21,0)") + F.coalesce(c(tie_break[0]), F.lit(0)).cast("decimal(20,0)")


def multi_round(df: DataFrame, r: Roles = DEFAULT, min_rounds: int = 2, grain: str = "company",
                tie_break=None, order: bool = True) -> DataFrame:
    """Entities with at least ``min_rounds`` events (measure and date present).

    company, country, industry, total_rounds, first_date, first_layoffs,
    last_date, last_layoffs, cumulative_layoffs, days_of_crisis, trend
    (Escalating / Declining / Stable from the last vs the first event).

    Events are ordered by date, then by the ``tie_break`` columns (default
    ``r.tie_break``; integers that tell same-day events of an entity apart).
    They are required: without them a same-day tie would decide the trend.

    grain="company": one row per entity; country and industry come from its
    first event. grain="reference": one row per (entity, country, industry)
    where only the group holding the entity's first (last) event gets first
    (last) values — other groups keep NULL dates and fall to 'Stable', as the
    source query does. Either way the events are read once and never joined:
    both levels aggregate by hash, and only group rows meet in the join.
    """
    tb = tuple(tie_break if tie_break is not None else r.tie_break)
    if not tb:
        raise ValueError("multi_round needs a tie-break column (tie_break= or Roles.tie_break): "
                         "the order of same-day events would decide the trend")
    f = df.filter(not_null(r.total, r.date))
    if grain not in ("company", "reference"):
        raise ValueError(f"unknown grain {grain!r}")
    f = f.select(c(r.company).alias("company"), c(r.country).alias("country"), c(r.industry).alias("industry"),
                 c(r.date).alias("_d"), c(r.total).alias("_t"), _order_key(df, r.date, tb).alias("_k"))
    # Per (company, country, industry), by hash: counts, sums, and the ends with their dates and amounts.
    g = f.groupBy("company", "country", "industry").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_t").cast("long").alias("_s"),
        F.min("_k").alias("_k0"), F.min_by("_d", "_k").alias("_d0"), F.min_by("_t", "_k").alias("_t0"),
        F.max("_k").alias("_k1"), F.max_by("_d", "_k").alias("_d1"), F.max_by("_t", "_k").alias("_t1"))
    # Should two groups of a company share a key (a tie-break that does not tell all events apart), a hash of the group decides.
    wide = lambda k: c(k) * F.lit("1" + "0" * 11).cast("decimal(12,0)") + F.pmod(F.xxhash64("country", "industry"), F.lit(10**11)).cast("decimal(12,0)")
    g = one_plan(g.withColumns({k: wide(k).cast("decimal(38,0)") for k in ("_k0", "_k1")}), ["company", "country", "industry"])
    # Per company, from those groups.
    per = g.groupBy(c("company").alias("_co")).agg(
        F.sum("_n").alias("total_rounds"), F.sum("_s").cast("long").alias("_all"), F.min("_k0").alias("_first"), F.max("_k1").alias("_last"),
        F.max_by("_d1", "_k1").alias("_d9"), F.max_by("_t1", "_k1").alias("_t9")).filter(c("total_rounds") >= min_rounds)
    both = g.join(per, c("company").eqNullSafe(c("_co")))
    if grain == "company":  # the group that holds the first event stands for its company
        out = both.filter(c("_k0") == c("_first")).select(
            "company", "country", "industry", "total_rounds", c("_d0").alias("first_date"), c("_t0").alias("first_layoffs"),
            c("_d9").alias("last_date"), c("_t9").alias("last_layoffs"), c("_all").alias("cumulative_layoffs"))
    else:
        first, last = c("_k0") == c("_first"), c("_k1") == c("_last")
        out = both.select("company", "country", "industry", "total_rounds", F.when(first, c("_d0")).alias("first_date"),
                          F.when(first, c("_t0")).alias("first_layoffs"), F.when(last, c("_d1")).alias("last_date"),
                          F.when(last, c("_t1")).alias("last_layoffs"), c("_s").alias("cumulative_layoffs"))
    out = out.select("*", F.datediff("last_date", "first_date").alias("days_of_crisis"),
                     trend("first_layoffs", "last_layoffs").alias("trend"))
    return ordered(out, order, F.desc("total_rounds"), F.desc("cumulative_layoffs"), "company", "country", "industry")


def distress_screen(rounds: DataFrame, min_rounds: int = 4, declining_rounds: int = 3,
                    order: bool = True) -> DataFrame:
    """From `multi_round`: entities in an escalating spiral (>= ``min_rounds``,
    Escalating) or a managed decline (Declining, >= ``declining_rounds``),
    with last_vs_first_pct = last / first event size in percent (1 dp).
    Sorted by crisis length."""
    esc, dec, _ = TREND_LABELS
    screen = (F.when((c("total_rounds") >= min_rounds) & (c("trend") == esc), F.lit("escalating_distress"))
               .when((c("trend") == dec) & (c("total_rounds") >= declining_rounds), F.lit("managed_decline")))
    out = (rounds.select("*", screen.alias("screen"),
                         percent("last_layoffs", "first_layoffs", 1).alias("last_vs_first_pct"))
                 .filter(c("screen").isNotNull()))
    return ordered(out, order, F.desc_nulls_last("days_of_crisis"), "company")


# --------------------------------------------------------------------------- A3


def cross_matrix(df: DataFrame, r: Roles = DEFAULT, a: str = "industry", b: str = "stage", exclude=UNKNOWN,
                 approx: bool = False, order: bool = True) -> DataFrame:
    """``a`` x ``b`` matrix (industry x stage by default): num_companies,
    total_laid_off, avg_laid_off, num_events, pct_of_<a>, pct_of_<b>
    (DECIMAL(5,1)), rank_in_<b>, rank_in_<a> (RANK by total, ties share a
    rank). Windows run over the aggregated cells only."""
    ca, cb = getattr(r, a, a), getattr(r, b, b)
    f = df.filter(excluding(ca, exclude) & excluding(cb, exclude) & c(r.total).isNotNull())
    g = (f.groupBy(c(ca).alias(a), c(cb).alias(b))
          .agg((F.approx_count_distinct(r.company) if approx else F.countDistinct(r.company)).alias("num_companies"),
               F.sum(r.total).cast("long").alias("total_laid_off"),
               int_avg(r.total).alias("avg_laid_off"),
               F.count(F.lit(1)).alias("num_events")))
    by_b = Window.partitionBy(b)
    by_a = Window.partitionBy(a)
    out = g.select(
        a, b, "num_companies", "total_laid_off", "avg_laid_off", "num_events",
        pct_ratio("total_laid_off", F.sum("total_laid_off").over(by_a)).alias(f"pct_of_{a}"),
        pct_ratio("total_laid_off", F.sum("total_laid_off").over(by_b)).alias(f"pct_of_{b}"),
        F.rank().over(by_b.orderBy(F.desc("total_laid_off"))).alias(f"rank_in_{b}"),
        F.rank().over(by_a.orderBy(F.desc("total_laid_off"))).alias(f"rank_in_{a}"))
    return ordered(out, order, F.desc("total_laid_off"), a, b)


def dominant_cells(matrix: DataFrame, min_pct: float = 50, order: bool = True) -> DataFrame:
    """From `cross_matrix`: cells that lead their stage, lead their industry, or
    hold more than ``min_pct`` percent of their industry's total."""
    out = (matrix.select("*", (c("rank_in_stage") == 1).alias("top_in_stage"),
                         (c("rank_in_industry") == 1).alias("top_in_industry"),
                         (c("pct_of_industry") > F.lit(min_pct)).alias("concentrated"))
                 .filter(c("top_in_stage") | c("top_in_industry") | c("concentrated")))
    return ordered(out, order, F.desc("total_laid_off"), "industry", "stage")


# --------------------------------------------------------------------------- A4 / A12


def percentiles(df: DataFrame, col: str = "total_laid_off", qs=QUANTILES, names=QUANTILE_NAMES,
                approx: bool = False, scale: int = 4, accuracy: int = 100_000) -> DataFrame:
    """One row of interpolated percentiles (Q1, median, Q3, P90, P99); no row
    when the column has no values. Values are rounded to ``scale`` decimals.

    Exact, lazy and bounded in memory (`quantiles`, which also defines ranks
    for infinite values and NaN); ``approx`` takes one ``percentile_approx``
    pass instead.
    """
    if approx:
        f = df.filter(c(col).isNotNull())
        g = f.agg(F.percentile_approx(c(col).cast("double"), list(qs), accuracy).alias("_p"), F.count(F.lit(1)).alias("_n")).filter(c("_n") > 0)
        return g.select(*[F.round(c("_p")[i], scale).alias(n) for i, n in enumerate(names)])
    found = quantiles(df, col, qs)
    return found.select(*[F.round(F.get("values", F.lit(i)), scale).alias(n) for i, n in enumerate(names)])


def adaptive_cutoff(df: DataFrame, col: str = "total_laid_off", q: float = 0.9) -> Column:
    """The ``q`` percentile of ``col`` as a lazy scalar, usable as the ``threshold``
    of every segment operator (NULL when the column has no values)."""
    return quantiles(df, col, [q]).select(F.get("values", F.lit(0))).scalar()


def adaptive_threshold(df: DataFrame, r: Roles = DEFAULT, q: float = 0.9, scale: int = 4) -> DataFrame:
    """Distribution-based cut-off instead of a fixed one.

    One row: Q1, median, Q3, P90, P99, IQR, p99_over_p90, mean_value,
    right_skewed (mean > median), cutoff (the ``q`` percentile), events_at_or_above
    and workers_share_pct (share of the measure in events >= cutoff, 2 dp).
    """
    f = df.filter(c(r.total).isNotNull())
    found = quantiles(f, r.total, [*QUANTILES, q]).select("values").scalar()
    *p, cut = [F.get(found, F.lit(i)) for i in range(len(QUANTILES) + 1)]
    above = c(r.total) >= cut
    stats = f.agg(F.sum(r.total).cast("long").alias("_s"), F.count(F.lit(1)).alias("_n"), F.count_if(above).alias("_above"),
                  F.sum(F.when(above, c(r.total))).cast("long").alias("_s_above")).filter(c("_n") > 0)
    n_above, s_above = c("_above"), c("_s_above")
    mean = c("_s").cast("double") / c("_n").cast("double")
    return stats.select(
        *[F.round(x, scale).alias(n) for x, n in zip(p, QUANTILE_NAMES)],
        F.round(p[2] - p[0], scale).alias("IQR"),
        F.round(F.try_divide(p[4], p[3]), scale).alias("p99_over_p90"),
        F.round(mean, scale).alias("mean_value"),
        (mean > p[1]).alias("right_skewed"),
        F.round(cut, scale).alias("cutoff"),
        n_above.alias("events_at_or_above"),
        percent(F.coalesce(s_above, F.lit(0)), c("_s"), 2).alias("workers_share_pct"))


# --------------------------------------------------------------------------- A5-A10


def _segmented(df: DataFrame, r: Roles, threshold) -> DataFrame:
    return df.filter(c(r.total).isNotNull()).withColumn("group_label", segment(r.total, threshold))


def segment_stats(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD, order: bool = True) -> DataFrame:
    """Per size segment: total_events, min_value, max_value, avg_value (0 dp),
    median, std_dev (sample, 0 dp), cv_ratio and coef_variation.

    cv_ratio is mean / std as the source computes it (its comment says the
    reverse); coef_variation is the textbook std / mean. An empty segment has
    no row; a one-row segment has NULL std. One groupBy instead of the
    source's four scans and cross joins; medians are exact (`quantiles`).
    """
    g = (_segmented(df, r, threshold).groupBy("group_label")
         .agg(F.count(F.lit(1)).alias("total_events"), F.min(r.total).alias("min_value"),
              F.max(r.total).alias("max_value"), F.sum(r.total).cast("long").alias("_s"),
              F.stddev_samp(c(r.total).cast("double")).alias("_std")))
    medians = quantiles(_segmented(df, r, threshold), r.total, [0.5], "group_label")
    g = g.join(medians.select("group_label", F.get("values", F.lit(0)).alias("_median")), "group_label")
    mean = c("_s").cast("double") / c("total_events").cast("double")
    out = g.select(
        "group_label", "total_events", "min_value", "max_value",
        ratio("_s", "total_events", 0).alias("avg_value"),
        F.round("_median", 4).alias("median"),
        F.round("_std", 0).alias("std_dev"),
        F.round(F.try_divide(mean, c("_std")), 2).alias("cv_ratio"),
        F.round(F.try_divide(c("_std"), mean), 2).alias("coef_variation"))
    return ordered(out, order, "group_label")


def segment_share(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD, order: bool = True) -> DataFrame:
    """group_label, events, total_workers, pct_of_all_layoffs (2 dp)."""
    g = (_segmented(df, r, threshold).groupBy("group_label")
         .agg(F.count(F.lit(1)).alias("events"), F.sum(r.total).cast("long").alias("total_workers")))
    out = g.select("group_label", "events", "total_workers",
                   percent("total_workers", F.sum("total_workers").over(whole()), 2)
                   .alias("pct_of_all_layoffs"))
    return ordered(out, order, "group_label")


def _segment_industries(df: DataFrame, r: Roles, cond: Column, pct_name: str, order: bool) -> DataFrame:
    g = (df.filter(c(r.total).isNotNull() & cond).groupBy(c(r.industry).alias("industry"))
           .agg(F.count(F.lit(1)).alias("events"), F.sum(r.total).cast("long").alias("total_workers"),
                int_avg(r.total).alias("avg_per_event")))
    out = g.select("industry", "events", "total_workers", "avg_per_event",
                   percent("total_workers", F.sum("total_workers").over(whole()), 2).alias(pct_name))
    return ordered(out, order, F.desc("total_workers"), "industry")


def _threshold_col(threshold) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(threshold)


def segment_breakdown_huge(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD,
                           order: bool = True) -> DataFrame:
    """Industries inside the Huge segment: events, total_workers,
    avg_per_event (integer average), pct_of_huge_group (2 dp)."""
    return _segment_industries(df, r, c(r.total) >= _threshold_col(threshold), "pct_of_huge_group", order)


def segment_breakdown_small(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD,
                            order: bool = True) -> DataFrame:
    """Industries inside the Small segment (same columns, pct_of_small_group)."""
    return _segment_industries(df, r, c(r.total) < _threshold_col(threshold), "pct_of_small_group", order)


def _segment_by(df: DataFrame, r: Roles, threshold, key: Column, key_name: str, order: bool) -> DataFrame:
    g = (df.groupBy("group_label", key.alias(key_name))
           .agg(F.count(F.lit(1)).alias("events"), F.sum(r.total).cast("long").alias("total_workers"),
                int_avg(r.total).alias("avg_per_event")))
    out = g.select("group_label", key_name, "events", "total_workers", "avg_per_event",
                   percent("total_workers", F.sum("total_workers").over(Window.partitionBy("group_label")), 2)
                   .alias("pct_within_group"))
    return out


def segment_by_country(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD, order: bool = True) -> DataFrame:
    """group_label, country, events, total_workers, avg_per_event, pct_within_group."""
    out = _segment_by(_segmented(df, r, threshold), r, threshold, c(r.country), "country", order)
    return ordered(out, order, "group_label", F.desc("total_workers"), "country")


def segment_by_year(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD, order: bool = True) -> DataFrame:
    """group_label, year, events, total_workers, avg_per_event, pct_within_group
    (rows with a date)."""
    seg = _segmented(df, r, threshold).filter(c(r.date).isNotNull())
    out = _segment_by(seg, r, threshold, year_of(r), "year", order)
    return ordered(out, order, "group_label", "year")


# --------------------------------------------------------------------------- A11 / A15


def zscore(df: DataFrame, r: Roles = DEFAULT, threshold=SEGMENT_THRESHOLD, bands=(4, 3, 2, 1),
           scale: int = 4, order: bool = False) -> DataFrame:
    """Per event: z-score of the measure within its size segment.

    company, industry, country, date, total_laid_off, group_label, group_mean,
    group_std (sample; both rounded to ``scale``), z_score (2 dp),
    severity_label (|z| >= 4/3/2/1; NULL z is 'Normal'), direction (sign).

    Segment statistics use every event with a measure; scored events also
    need a date (as in the source). The statistics frame has one row per
    segment label (two), so it is broadcast: no shuffle of the events; sorting
    them all (``order``) is off unless asked for.
    """
    stats = (_segmented(df, r, threshold).groupBy("group_label")
             .agg(F.sum(r.total).cast("long").alias("_s"), F.count(F.lit(1)).alias("_n"),
                  F.stddev_samp(c(r.total).cast("double")).alias("_std")))
    stats = stats.select("group_label", (c("_s").cast("double") / c("_n").cast("double")).alias("_mean"), "_std")
    rows = _segmented(df, r, threshold).filter(c(r.date).isNotNull())
    j = rows.join(F.broadcast(stats), "group_label")
    z = F.try_divide(c(r.total) - c("_mean"), F.when(c("_std") != 0, c("_std")))
    out = j.select(
        c(r.company).alias("company"), c(r.industry).alias("industry"), c(r.country).alias("country"),
        c(r.date).alias("date"), c(r.total).alias("total_laid_off"), "group_label",
        F.round("_mean", scale).alias("group_mean"), F.round("_std", scale).alias("group_std"),
        (F.round(z, 2) + F.lit(0.0)).alias("z_score"),  # + 0.0 turns -0.0 into 0.0
        severity(z, bands).alias("severity_label"),
        direction(z).alias("direction"))
    return ordered(out, order, F.desc_nulls_last("z_score"), F.desc("total_laid_off"), "company", "date")


def outlier_screen(z: DataFrame, z_cut: float = 3, low: float = -1, order: bool = True) -> DataFrame:
    """From `zscore`: extreme outliers, Small-segment events with z > ``z_cut``
    and unusually small events (z < ``low``), flagged."""
    out = (z.select("*", (c("severity_label") == SEVERITY_LABELS[0]).alias("extreme"),
                    (c("group_label").startswith("Small") & (c("z_score") > z_cut)).alias("small_but_strong"),
                    (c("z_score") < low).alias("unusually_small"))
            .filter(c("extreme") | c("small_but_strong") | c("unusually_small")))
    return ordered(out, order, F.desc_nulls_last("z_score"), F.desc("total_laid_off"), "company", "date")


def outlier_clusters(z: DataFrame, n: int = 10, order: bool = True) -> DataFrame:
    """Do the top-``n`` z-scores cluster? year, industry, num_top_outliers.

    Top-n by z (then size, names, date) via TakeOrderedAndProject, then a
    tiny aggregate."""
    top = z.orderBy(F.desc_nulls_last("z_score"), F.desc("total_laid_off"), "company", "date",
                    "industry", "country").limit(n)
    out = (top.groupBy(F.year("date").cast("int").alias("year"), "industry")
              .agg(F.count(F.lit(1)).alias("num_top_outliers")))
    return ordered(out, order, F.desc("num_top_outliers"), "year", "industry")


# --------------------------------------------------------------------------- P2-P5 (our definitions)


def funding_paradox(df: DataFrame, r: Roles = DEFAULT, buckets: int = 5, order: bool = True) -> DataFrame:
    """Funding quantile buckets x (events, min/max funds, total, integer average,
    pearson r of measure vs funds). Our definition of a finding the source
    only names.

    Breakpoints are the exact funds percentiles at 1/b, 2/b, ... (`quantiles`)
    rounded to cents; bucket k holds funds in (bp[k-1], bp[k]]. No global sort
    or ntile.
    """
    f = df.filter(not_null(r.total, r.funds))
    qs = [i / buckets for i in range(1, buckets)]
    bps = quantiles(f, r.funds, qs).select("values").scalar()
    bucket = F.lit(1)
    for i in range(len(qs)):
        bucket = bucket + (c(r.funds) > F.round(F.get(bps, F.lit(i)), 2)).cast("int")
    x, y = c(r.total).cast("double"), c(r.funds)
    g = (f.groupBy(bucket.alias("funding_bucket"))
          .agg(F.count(F.lit(1)).alias("events"), F.min(r.funds).alias("min_funds"), F.max(r.funds).alias("max_funds"),
               F.sum(r.total).cast("long").alias("total_laid_off"), int_avg(r.total).alias("avg_laid_off"),
               F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 3)
               .alias("pearson_correlation")))
    return ordered(g, order, "funding_bucket")


def riskiest_stage(df: DataFrame, r: Roles = DEFAULT, exclude=UNKNOWN, order: bool = True) -> DataFrame:
    """Per stage (our definition): events with a rate, weighted_rate_pct =
    sum(total) / sum(total / pct) in percent (2 dp), shutdown_share_pct
    (rate = 1), avg_rate (4 dp), risk_rank by weighted rate."""
    f = df.filter(excluding(r.stage, exclude) & c(r.pct).isNotNull())
    usable = c(r.total).isNotNull() & (c(r.pct) > 0)
    g = (f.groupBy(c(r.stage).alias("stage"))
          .agg(F.count(F.lit(1)).alias("events"), F.count_if(c(r.pct) >= 1).alias("_sd"),
               F.sum(scaled(r.pct, 6)).alias("_micro"),
               F.sum(F.when(usable, c(r.total))).alias("_t"),
               F.sum(F.when(usable, scaled(c(r.total) / c(r.pct), 6))).alias("_est")))
    wr = percent(c("_t").cast("decimal(30,0)") * F.lit(1_000_000), "_est", 2)
    out = g.select("stage", "events", wr.alias("weighted_rate_pct"),
                   percent("_sd", "events", 2).alias("shutdown_share_pct"),
                   ratio("_micro", c("events") * 1_000_000, 4).alias("avg_rate"))
    out = out.withColumn("risk_rank", F.rank().over(Window.orderBy(F.desc_nulls_last("weighted_rate_pct"))))
    return ordered(out, order, "risk_rank", "stage")


def survival_rate(df: DataFrame, r: Roles = DEFAULT, by: str = "stage", order: bool = True) -> DataFrame:
    """Shutdown (rate = 1) survival by a dimension, per event and per company
    (our definition): events, shutdown_events, event_survival_pct, companies,
    shutdown_companies, company_survival_pct. ``by``: a role, a column, or
    "year" (of the date; NULL dates left out). Two-level aggregation, no join."""
    key = getattr(r, by, by)
    if by == "year" and "year" not in df.columns:
        df, key = df.filter(c(r.date).isNotNull()).withColumn("_year", year_of(r)), "_year"
    per = (df.filter(c(r.pct).isNotNull())
             .groupBy(c(key).alias(by), c(r.company).alias("_co"))
             .agg(F.count(F.lit(1)).alias("_ev"), F.count_if(c(r.pct) >= 1).alias("_sd"),
                  F.max(r.pct).alias("_mx")))
    g = per.groupBy(by).agg(F.sum("_ev").alias("events"), F.sum("_sd").alias("shutdown_events"),
                            F.count(F.lit(1)).alias("companies"), F.count_if(c("_mx") >= 1).alias("shutdown_companies"))
    out = g.select(by, "events", "shutdown_events",
                   percent(c("events") - c("shutdown_events"), "events", 2).alias("event_survival_pct"),
                   "companies", "shutdown_companies",
                   percent(c("companies") - c("shutdown_companies"), "companies", 2)
                   .alias("company_survival_pct"))
    return ordered(out, order, by)


def funded_shutdowns(df: DataFrame, r: Roles = DEFAULT, min_funds: float = 1000, rate: float = 1.0,
                     order: bool = True) -> DataFrame:
    """Shutdowns (rate = 1) of entities that had raised at least ``min_funds``."""
    out = df.filter((c(r.pct) == F.lit(rate)) & (c(r.funds) >= F.lit(min_funds))).select(
        c(r.company).alias("company"), c(r.industry).alias("industry"), c(r.country).alias("country"),
        c(r.funds).alias("funds_raised_millions"), c(r.date).alias("date"))
    return ordered(out, order, F.desc("funds_raised_millions"), "company", "date")
