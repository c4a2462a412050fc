"""Operators on hand-made event rows: the edge cases of each rule."""

import datetime as dt
from decimal import Decimal

from eventlens import Roles
from eventlens.operators import analyze as A
from eventlens.operators import breakdown as K
from eventlens.operators import profile as P
from eventlens.operators import trend as T

from .conftest import ev, rows

R = Roles(tie_break=("event_id",))


def test_yoy_first_year_and_zero_previous(events):
    df = events(ev(date="2020-03-01", total=0), ev(date="2021-03-01", total=50), ev(date="2022-03-01", total=25),
                ev(date="2022-05-01", total=None))
    out = rows(T.yoy_change(df, R), "year", "total_laid_off", "yoy_change", "yoy_growth_pct")
    assert out == [(2020, 0, None, None), (2021, 50, 50, None), (2022, 25, -25, Decimal("-0.5000"))]


def test_mom_previous_present_month_and_fill_gaps(events):
    df = events(ev(date="2022-01-10", total=10), ev(date="2022-03-10", total=30))
    assert rows(T.mom_change(df, R), "yr_month", "mom_change") == [("2022-01", None), ("2022-03", 20)]
    filled = rows(T.mom_change(df, R, fill_gaps=True), "yr_month", "monthly_total", "mom_change")
    assert filled == [("2022-01", 10, None), ("2022-02", 0, -10), ("2022-03", 30, 30)]


def test_rolling_total_ends_at_grand_total(events):
    df = events(*[ev(date=f"2022-{m:02d}-01", total=m) for m in range(1, 13)], ev(date="2023-01-01", total=100))
    out = rows(T.rolling_total(df, R), "rolling_total")
    assert out[-1][0] == sum(range(1, 13)) + 100
    assert rows(T.rolling_total(df, R, grain="year"), "year", "rolling_total") == [(2022, 78), (2023, 178)]


def test_yearly_totals_count_null_measures(events):
    df = events(ev(total=None), ev(total=5), ev(date=None, total=7))
    assert rows(T.yearly_totals(df, R)) == [(2022, 5, 2, 5)]


def test_top_k_keeps_ties_at_the_cut(events):
    df = events(*[ev(company=c, total=t) for c, t in
                  [("a", 60), ("b", 50), ("c", 40), ("d", 30), ("e", 20), ("f", 20), ("g", 10)]])
    out = rows(K.top_k_per_group(df, R, k=5), "rnk", "company")
    assert out == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (5, "f")]


def test_outliers_use_truncated_integer_average(events):
    # mean = 31/3 = 10.33 -> 10 (integer average); threshold 2 x 10 = 20; 21 qualifies
    df = events(ev(total=5), ev(total=5), ev(total=21), ev(total=None))
    out = rows(K.outliers_vs_mean(df, R), "total_laid_off", "global_avg", "outlier_avg")
    assert out == [(21, 10, 21)]


def test_pearson_constant_input_is_null(events):
    df = events(ev(total=5, funds=1.0), ev(total=5, funds=2.0))
    assert K.pearson(df).first()[0] is None
    df2 = events(ev(total=1, funds=1.0), ev(total=2, funds=2.0), ev(total=3, funds=3.5))
    assert K.pearson(df2).first()[0] == 0.993
    one = events(ev(total=1, funds=1.0))
    assert K.pearson(one).first()[0] is None
    assert rows(K.correlation_strength(K.pearson(df2)), "strength", "relation") == [("strong", "positive")]


def test_city_breakdown_rate_identity(events):
    # 3,000 at 3% -> est. headcount 100,000 -> 3.00
    df = events(ev(company="S", location="Walldorf", country="Germany", total=3000, pct=0.03, funds=10.0),
                ev(company="T", location="Vienna", country="Austria", total=270, pct=0.27, funds=5.0),
                ev(company="U", location="Vienna", country="Austria", total=None, pct=0.5, funds=5.0),
                ev(company="V", location="Vienna", country="Austria", total=10, pct=0.0, funds=5.0))
    out = {r.city: (r.layoff_rate_raw, r.num_companies, r.city_rank) for r in K.city_breakdown(df, R).collect()}
    assert out == {"Walldorf": (Decimal("3.00"), 1, 1), "Vienna": (Decimal("27.00"), 1, 1)}


def test_shutdowns_nulls_last(events):
    df = events(ev(company="a", pct=1.0, funds=None), ev(company="b", pct=1.0, funds=5.0), ev(company="c", pct=0.5))
    assert rows(K.shutdowns(df, R), "company") == [("b",), ("a",)]


def test_segments_one_row_and_empty(events):
    df = events(ev(total=5000), ev(total=10), ev(total=20), ev(total=30))
    st = {r.group_label: r for r in A.segment_stats(df, R).collect()}
    assert st["Huge (≥3,000)"].std_dev is None and st["Huge (≥3,000)"].cv_ratio is None
    assert st["Small (<3,000)"].std_dev == 10.0 and st["Small (<3,000)"].median == 20.0
    small_only = events(ev(total=10), ev(total=20))
    assert [r.group_label for r in A.segment_stats(small_only, R).collect()] == ["Small (<3,000)"]
    share = {r.group_label: r.pct_of_all_layoffs for r in A.segment_share(df, R).collect()}
    assert share == {"Huge (≥3,000)": 98.81, "Small (<3,000)": 1.19}  # 5000 / 5060, 60 / 5060


def test_zscore_constant_measure_is_normal(events):
    df = events(ev(total=7), ev(total=7), ev(total=7, date=None))
    out = rows(A.zscore(df, R), "z_score", "severity_label", "group_mean")
    assert out == [(None, "Normal", 7.0), (None, "Normal", 7.0)]   # the undated row is not scored


def test_multi_round_ties_and_grains(events):
    df = events(ev(company="a", country="X", date="2022-01-01", total=10, event_id=2),
                ev(company="a", country="Y", date="2022-01-01", total=30, event_id=1),
                ev(company="a", country="X", date="2022-06-01", total=20, event_id=3),
                ev(company="b", date="2022-01-01", total=5))
    c = rows(A.multi_round(df, R), "company", "country", "total_rounds", "first_layoffs", "last_layoffs", "trend",
             "days_of_crisis")
    assert c == [("a", "Y", 3, 30, 20, "Declining", 151)]
    ref = {r.country: r for r in A.multi_round(df, R, grain="reference").collect()}
    assert ref["Y"].first_layoffs == 30 and ref["Y"].last_date is None and ref["Y"].trend == "Stable"
    assert ref["X"].first_date is None and ref["X"].last_layoffs == 20


def test_percentiles_and_empty_input(events):
    df = events(*[ev(total=t) for t in (1, 2, 3, 4, 100)])
    assert rows(A.percentiles(df)) == [(2.0, 3.0, 4.0, 61.6, 96.16)]
    assert A.percentiles(events(ev(total=None))).count() == 0


def test_pivot_share_sums(events):
    df = events(ev(stage="A", date="2020-01-01", total=10), ev(stage="B", date="2020-01-01", total=30),
                ev(stage="A", date="2021-01-01", total=5), ev(stage="Unknown", date="2021-01-01", total=99),
                ev(stage=None, date="2021-01-01", total=99))
    out = {r.stage: r for r in A.pivot_share(df, R, years=[2020, 2021]).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"].y2020_pct == Decimal("25.0") and out["B"].y2021 == 0 and out["A"].y2021_pct == Decimal("100.0")
    assert out["A"].grand_total == 15 and out["A"].total_pct == Decimal("33.3")


def test_kpi_and_workforce(events):
    df = events(ev(company="a", total=10, pct=0.5, funds=1.005), ev(company="b", total=5, pct=0.0, funds=2.0),
                ev(company="a", total=None, pct=None, funds=None))
    kpi = dict((r.measure_name, r.measure_value) for r in P.kpi_summary(df).collect())
    assert kpi["Number of Companies"] == 2 and kpi["Total Layoffs"] == 15 and kpi["Average Layoffs"] == 7
    assert kpi["Average Layoff Rate"] == 0.5
    wf = P.workforce_estimate(df).first()
    assert (wf.estimated_employees, wf.total_laid_off, wf.overall_layoff_rate) == (20, 10, 0.5)


def test_null_profile_counts(events):
    df = events(ev(company=None, total=None), ev(total=None), ev())
    prof = {r.column: (r.null_count, r.null_percentage) for r in P.null_profile(df).collect()}
    assert prof["total_laid_off"] == (2, 66.7) and prof["company"] == (1, 33.3) and prof["stage"] == (0, 0.0)


def test_survival_and_funded_shutdowns(events):
    df = events(ev(company="a", pct=1.0, funds=2000.0), ev(company="a", pct=0.2), ev(company="b", pct=0.3),
                ev(company="c", pct=1.0, funds=10.0))
    sv = A.survival_rate(df, R).first()
    assert (sv.events, sv.shutdown_events, sv.companies, sv.shutdown_companies) == (4, 2, 3, 2)
    assert sv.event_survival_pct == 50.0 and sv.company_survival_pct == 33.33
    assert rows(A.funded_shutdowns(df, R), "company") == [("a",)]


def test_dates_are_dates(events):
    df = events(ev(date=dt.date(2021, 2, 28)))
    assert rows(P.year_coverage(df, R)) == [(2021, dt.date(2021, 2, 28), dt.date(2021, 2, 28), 1)]


def test_signature_options(events):
    df = events(ev(company="a", country="X", total=5), ev(company="b", country="X", total=9),
                ev(company="c", country="Y", total=1))
    by_country = rows(K.top_k_per_group(df, R, k=1, by="country"), "country", "rnk", "company")
    assert by_country == [("X", 1, "b"), ("Y", 1, "c")]
    m = A.cross_matrix(df, R, a="country", b="industry")
    assert {"pct_of_country", "rank_in_industry"} <= set(m.columns)
    cs = K.correlation_strength(K.pearson(events(ev(total=1, funds=1.0), ev(total=2, funds=2.0),
                                                 ev(total=3, funds=3.5))), cuts=(0.999, 0.9999))
    assert rows(cs, "strength") == [("weak",)]
    prof = {r.column: r for r in P.null_profile(events(ev(company=None), ev()), display=True).collect()}
    assert prof["company"].null_percentage_text == "50.0%" and prof["company"].total_rows_text == "2"


def test_percentiles_of_infinite_values_and_nan(spark):
    from eventlens.operators.quantiles import quantiles
    inf, nan = float("inf"), float("nan")

    def of(values, qs, **kw):
        df = spark.createDataFrame([(v, "g") for v in values], "x double, g string")
        return [repr(x) for x in quantiles(df, "x", qs, **kw).first()["values"]]

    assert of([1.0, 2.0, inf], [0, 0.25, 0.5, 0.75, 1]) == ["1.0", "1.5", "2.0", "inf", "inf"]
    assert of([-inf, 5.0, inf, nan, None], [0, 0.1, 1 / 3, 0.5, 2 / 3, 0.9, 1]) == ["-inf", "-inf", "5.0", "inf", "inf", "nan", "nan"]
    assert of([-inf, inf], [0.5]) == ["nan"] and of([nan] * 3, [0.5]) == ["nan"] and of([inf, inf], [0.3]) == ["inf"]
    many = [inf] * 400 + [-inf] * 300 + [nan] * 100 + [float(i) for i in range(1000)]
    want = sorted(many, key=lambda v: (v != v, v))
    for accuracy in (10_000, 50):
        ranks = [0, 299, 300, 800, 1299, 1300, 1699, 1700, 1799]
        assert of(many, [k / 1799 for k in ranks], accuracy=accuracy) == [repr(want[k]) for k in ranks]
    df = spark.createDataFrame([(v, g) for g in ("a", None) for v in (many if g else [1.0, 4.0])], "x double, g string")
    both = {r.g: (r.n, r["values"]) for r in quantiles(df, "x", [0.5], "g").collect()}
    assert both == {"a": (1800, [(want[899] + want[900]) / 2]), None: (2, [2.5])}


def test_percentiles_match_the_engines_own(events, spark):
    import random

    from eventlens.operators import quantiles
    from eventlens.sources import fact_view
    from .conftest import SF_SMALL
    f = fact_view(spark, SF_SMALL)

    def own(df, col):
        p = df.selectExpr(f"percentile({col}, array(0.25, 0.5, 0.75, 0.9, 0.99)) as p").first().p
        return [tuple(round(x, 4) for x in p)]
    qs = [0.25, 0.5, 0.75, 0.9, 0.99]
    for accuracy, bins in ((10_000, 4096), (100, 3), (20, 1)):  # narrow and wide brackets, many and few bins: the same values
        for col in ("total_skewed", "funds_raised_millions"):
            got = quantiles.quantiles(f, col, qs, accuracy=accuracy, bins=bins).first()
            assert [tuple(round(x, 4) for x in got["values"])] == own(f, col)
            assert got.n == f.where(f"{col} is not null").count()
    rng = random.Random(1)
    spread = spark.createDataFrame([(rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),) for _ in range(99)] + [(0.0,), (None,)], "x double")
    got = quantiles.quantiles(spread, "x", [0, 0.25, 0.5, 1]).first()["values"]
    values = sorted(r.x for r in spread.where("x is not null").collect())
    assert got == [values[0], values[24] + (values[25] - values[24]) * 0.75, values[49] + (values[50] - values[49]) * 0.5, values[-1]]
    for df in (events(ev(total=7)), events(*[ev(total=3) for _ in range(5)])):
        assert rows(A.percentiles(df)) == own(df, "total_laid_off")
    assert A.percentiles(events(ev(total=None))).count() == 0
    assert A.adaptive_threshold(events(ev(total=None)), R).count() == 0
    assert A.funding_paradox(events(ev(total=None)), R).count() == 0


def test_same_day_events_need_a_tie_break(events):
    import pytest
    df = events(ev(company="a", total=500, event_id=1), ev(company="a", total=10, event_id=2))
    assert rows(A.multi_round(df, R), "first_layoffs", "last_layoffs", "trend") == [(500, 10, "Declining")]
    for grain in ("company", "reference"):
        with pytest.raises(ValueError, match="tie-break"):
            A.multi_round(df, grain=grain)


def test_survival_by_year(events):
    df = events(ev(date="2022-01-01", pct=1.0), ev(date="2022-05-01", pct=0.1, company="b"), ev(date="2023-01-01", pct=0.2), ev(date=None, pct=1.0))
    assert rows(A.survival_rate(df, R, by="year"), "year", "events", "shutdown_events", "event_survival_pct") == [(2022, 2, 1, 50.0), (2023, 1, 0, 100.0)]


def test_shift_between_the_years_of_the_data(events):
    df = events(ev(stage="A", date="2020-01-01", total=1), ev(stage="B", date="2020-01-01", total=3), ev(stage="A", date="2024-01-01", total=3),
                ev(stage="B", date="2024-01-01", total=1), ev(stage="A", date="2022-01-01", total=3), ev(stage="Unknown", date="2019-01-01", total=9))
    got = {r.stage: (r.first_year, r.last_year, float(r.share_shift_pp), r.peak_year) for r in A.shift_long(df, R).collect()}
    assert got == {"A": (2020, 2024, 50.0, 2022), "B": (2020, 2024, -50.0, 2020)}
    wide = {r.stage: r for r in A.pivot_share(df, R).collect()}
    for r in A.share_long(df, R).collect():
        assert (wide[r.stage][f"y{r.year}"], wide[r.stage][f"y{r.year}_pct"]) == (r.total, r.share_pct)


def test_growth_that_does_not_fit_is_null(events):
    from eventlens.operators import trend as T
    df = events(ev(date="2022-01-01", total=1), ev(date="2022-02-01", total=2_000_000_000), ev(date="2022-03-01", total=4))
    assert T.mom_change(df, R).count() == 3


def test_screens_and_slicers(events):
    from eventlens.operators import geo as G
    df = events(ev(company="a", date="2022-01-01", total=10), ev(company="a", date="2022-02-01", total=20),
                ev(company="a", date="2022-03-01", total=30), ev(company="a", date="2022-04-01", total=40),
                ev(company="b", date="2022-01-01", total=50, stage="S2", industry="I2"),
                ev(company="b", date="2022-05-01", total=40, stage="S2", industry="I2"),
                ev(company="b", date="2022-09-01", total=5, stage="S2", industry="I2"))
    rounds = A.multi_round(df, R)
    assert rows(A.multi_round(df, R, min_rounds=4), "company") == [("a",)]
    screen = {r.company: (r.screen, r.last_vs_first_pct) for r in A.distress_screen(rounds).collect()}
    assert screen == {"a": ("escalating_distress", 400.0), "b": ("managed_decline", 10.0)}
    cells = {(r.industry, r.stage): (r.top_in_stage, r.concentrated) for r in
             A.dominant_cells(A.cross_matrix(df, R)).collect()}
    assert cells == {("I1", "S1"): (True, True), ("I2", "S2"): (True, True)}
    z = A.zscore(df, R)
    flagged = {r.total_laid_off: (r.extreme, r.unusually_small) for r in A.outlier_screen(z).collect()}
    assert flagged[5] == (False, True)
    sliced = G.slice_events(df, R, years=[2022], industries=["I2"], stages=["S2"])
    assert sliced.count() == 3 and G.slice_events(df, R, stages=["nope"]).count() == 0


def test_approx_distinct_options(events):
    from eventlens.operators import geo as G
    df = events(ev(company="a"), ev(company="b"), ev(company="b", stage="S2"))
    assert rows(G.kpi_cards(df, R, approx=True), "num_companies") == rows(G.kpi_cards(df, R), "num_companies")
    assert sorted(rows(A.cross_matrix(df, R, approx=True), "num_companies")) == \
        sorted(rows(A.cross_matrix(df, R), "num_companies"))
