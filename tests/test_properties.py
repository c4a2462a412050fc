"""Invariants on the derived fixture tables (sf0.001)."""

from decimal import Decimal, ROUND_HALF_UP

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens import Roles
from eventlens.functions import ratio
from eventlens.operators import analyze as A
from eventlens.operators import clean as C
from eventlens.operators import trend as T
from eventlens.sources import fact_view, raw_view

from .conftest import SF_SMALL

R = Roles(tie_break=("event_id",))
RS = R.with_(total="total_skewed")


def _total(df, col="total_laid_off", cond=None):
    f = df if cond is None else df.filter(cond)
    return f.agg(F.sum(col)).first()[0]


def test_dedup_idempotent(spark):
    raw = raw_view(spark, SF_SMALL)
    once = C.exact_dedup(raw)
    assert C.exact_dedup(once).count() == once.count() < raw.count()


def test_rolling_total_ends_at_grand_total(spark):
    f = fact_view(spark, SF_SMALL)
    last = T.rolling_total(f, R).collect()[-1].rolling_total
    assert last == _total(f, cond=F.col("date").isNotNull())


def test_segment_totals_and_shares(spark):
    f = fact_view(spark, SF_SMALL)
    share = A.segment_share(f, RS).collect()
    assert sum(r.total_workers for r in share) == _total(f, "total_skewed")
    assert abs(sum(r.pct_of_all_layoffs for r in share) - 100) <= 0.01 * len(share)
    by_country = A.segment_by_country(f, RS).collect()
    for g in {r.group_label for r in by_country}:
        s = sum(r.pct_within_group for r in by_country if r.group_label == g)
        assert abs(s - 100) <= 0.01 * len(by_country)


def test_pivot_years_add_up(spark):
    f = fact_view(spark, SF_SMALL)
    years = list(range(1995, 2002))
    for r in A.pivot_share(f, R, years=years[:-1]).collect():   # last year left out on purpose
        assert sum(r[f"y{y}"] for y in years[:-1]) <= r.grand_total
    full = A.pivot_share(f, R, years=years).collect()
    for r in full:
        assert sum(r[f"y{y}"] for y in years) == r.grand_total
    assert abs(sum(r.total_pct for r in full) - Decimal(100)) <= Decimal("0.1") * len(full)


def test_ranks_start_at_one(spark):
    m = A.cross_matrix(fact_view(spark, SF_SMALL), R)
    per_stage = m.groupBy("stage").agg(F.min("rank_in_stage").alias("m")).collect()
    assert {r.m for r in per_stage} == {1}


def test_adaptive_cutoff_splits_at_p90(spark):
    f = fact_view(spark, SF_SMALL)
    at = A.adaptive_threshold(f, RS).first()
    n = f.filter(F.col("total_skewed").isNotNull()).count()
    assert abs(at.events_at_or_above - 0.1 * n) <= 0.02 * n + 1
    assert at.right_skewed


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(-10**6, 10**6).filter(lambda d: d != 0)),
                min_size=1, max_size=30),
       st.integers(0, 4))
def test_ratio_matches_exact_decimal_rounding(spark, pairs, scale):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(ratio("n", "d", scale)).collect()]
    q = Decimal(1).scaleb(-scale)
    for (n, d), g in zip(pairs, got):
        exact = (Decimal(abs(n)) / Decimal(abs(d))).quantize(q, rounding=ROUND_HALF_UP)
        exact = -exact if (n < 0) != (d < 0) else exact
        assert g == float(exact)
