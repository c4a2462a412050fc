"""Physical-plan shape: the scale decisions are visible in explain()."""

import re

from eventlens import Roles
from eventlens.operators import analyze as A
from eventlens.operators import breakdown as K
from eventlens.operators import clean as C
from eventlens.operators import geo as G
from eventlens.operators import trend as T
from eventlens.plans.sinks import write_event_table
from eventlens.sources import fact_view, raw_view

from .conftest import SF_SMALL

R = Roles(tie_break=("event_id",))
RS = R.with_(total="total_skewed")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def full_plan(df):
    return df._jdf.queryExecution().toString()


def test_zscore_broadcasts_only_the_segment_stats(spark):
    p = plan(A.zscore(fact_view(spark, SF_SMALL), RS, order=False))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert "Window" not in p


def test_outliers_use_scalar_subquery_not_global_window(spark):
    df = K.outliers_vs_mean(fact_view(spark, SF_SMALL), RS, order=False)
    p = full_plan(df)
    assert "scalar-subquery" in p.lower() or "Subquery" in p
    assert "Window" not in plan(df)


def test_multi_round_has_no_window_over_events(spark):
    f = fact_view(spark, SF_SMALL)
    assert "Window" not in plan(A.multi_round(f, R, grain="company", order=False))
    ref = A.multi_round(f, R, grain="reference", order=False)
    assert not _windows_over_raw_rows(ref._jdf.queryExecution().optimizedPlan().toString())
    for grain in ("company", "reference"):
        # ordering keys are fixed-width: no aggregate has to sort the raw events
        assert "SortAggregate" not in plan(A.multi_round(f, R, grain=grain, order=False).drop("days_of_crisis"))


def test_peak_root_cause_aggregates_by_hash(spark):
    assert "SortAggregate" not in plan(T.peak_root_cause(fact_view(spark, SF_SMALL), R, order=False))


def test_imputation_moves_only_the_rows_that_lack_a_value(spark):
    events = C.clean_stages(raw_view(spark, SF_SMALL))["informative"]
    for strategy in ("min", "mode"):
        p = plan(C.impute_from_peer(events, "company", "industry", strategy))
        assert "SortAggregate" not in p
        logical = C.impute_from_peer(events, "company", "industry", strategy)._jdf.queryExecution().optimizedPlan().toString()
        assert logical.count("Join LeftOuter") == 1 and logical.lstrip().startswith("Union")


def scans(df, column):
    """Scans of the final plan that read `column` (a reused exchange counts once)."""
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    return len(re.findall(r"FileScan parquet \[[^]]*" + column, final))


def test_cleaning_reads_the_landing_rows_once(spark):
    raw = raw_view(spark, SF_SMALL)
    for kw in ({}, {"strategy": "mode"}):
        assert scans(C.clean_events(raw, **kw), "o_totalprice") == 1
    assert scans(C.impute_from_peer(C.clean_stages(raw)["informative"]), "o_totalprice") == 1


def test_multi_round_reads_the_events_once(spark):
    f = fact_view(spark, SF_SMALL)
    for grain in ("company", "reference"):
        assert scans(A.multi_round(f, R, grain=grain), "o_totalprice") == 1


def test_percentiles_hold_no_values_in_one_task(spark):
    f = fact_view(spark, SF_SMALL)
    for df in (A.percentiles(f, "total_skewed"), A.segment_stats(f, RS), A.adaptive_threshold(f, RS), A.funding_paradox(f, RS),
               A.segment_stats(f, RS, threshold=A.adaptive_cutoff(f, "total_skewed"))):
        # the engine's exact percentile keeps all values of a group in one task; windows see counts only
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in text.replace("percentile_approx(", "") and not _windows_over_raw_rows(text)


def test_percentiles_read_the_events_twice(spark):
    f = fact_view(spark, SF_SMALL)
    # the sketch is a subquery; the counts are one exchange, used twice
    assert scans(A.percentiles(f, "total_skewed"), "o_totalprice") <= 2
    assert scans(A.adaptive_threshold(f, RS), "o_totalprice") <= 3


def test_top_k_uses_window_group_limit(spark):
    df = K.top_k_per_group(fact_view(spark, SF_SMALL), R, order=False)
    df.collect()
    assert "WindowGroupLimit" in plan(df)


def test_fact_view_streams_orders(spark):
    p = plan(fact_view(spark, SF_SMALL))
    # the fact table is the streamed side: every broadcast builds a dimension
    assert "BuildLeft" not in p


def test_year_slice_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "events")
    write_event_table(fact_view(spark, SF_SMALL), path)
    t = spark.read.parquet(path)
    s = G.slice_events(t, R, years=[1996], countries=["ASIA"])
    p = formatted(s)
    parts = p.split("PartitionFilters: [")[1].split("]")[0]
    assert "isnotnull(event_year" in parts and "= 1996)" in parts
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,1996-01-01)" in pushed and "EqualTo(country,ASIA)" in pushed
    assert s.count() == fact_view(spark, SF_SMALL).filter("year(date) = 1996 and country = 'ASIA'").count()


def _tree(plan_string):
    """(depth, node name) per line of a Catalyst tree string."""
    out = []
    for line in plan_string.splitlines():
        stripped = line.lstrip(" :|+-")
        if not stripped:
            continue
        depth = len(line) - len(stripped)
        out.append((depth, stripped.split(" ")[0].split("(")[0]))
    return out


def _windows_over_raw_rows(plan_string):
    """Window nodes whose subtree reaches a relation without passing an
    aggregate (i.e. a window evaluated over raw event rows)."""
    nodes = _tree(plan_string)
    bad = []
    for i, (d, name) in enumerate(nodes):
        if name != "Window":
            continue
        sub = []
        for d2, n2 in nodes[i + 1:]:
            if d2 <= d:
                break
            sub.append(n2)
        if not any(n.endswith("Aggregate") for n in sub) and any(n in ("Relation", "LogicalRDD") for n in sub):
            bad.append(i)
    return bad


def test_no_registered_query_windows_over_raw_rows(spark):
    from eventlens.plans import PLANS
    offenders = []
    for name, p in PLANS.items():
        if name in ("load_raw_csv", "load_audit", "incremental_landing"):
            continue  # these write landing files first; no windows in them
        lp = p.build(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        if _windows_over_raw_rows(lp):
            offenders.append(name)
    assert offenders == []


def test_broadcast_hints_only_on_bounded_frames(spark):
    from eventlens.plans import PLANS
    hinted = set()
    for name, p in PLANS.items():
        if name in ("load_raw_csv", "load_audit", "incremental_landing"):
            continue
        lp = p.build(spark, SF_SMALL)._jdf.queryExecution().analyzed().toString()
        if "strategy=broadcast" in lp:
            hinted.add(name)
    # only the z-score family: its broadcast side has one row per segment label
    assert hinted == {"zscore", "outlier_screen", "outlier_clusters"}


def test_window_guard_detects_raw_row_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    f = fact_view(spark, SF_SMALL)
    raw_window = f.withColumn("rn", F.row_number().over(Window.partitionBy("company").orderBy("date")))
    assert _windows_over_raw_rows(raw_window._jdf.queryExecution().optimizedPlan().toString())
    agg_window = K.city_breakdown(f, R, order=False)
    assert not _windows_over_raw_rows(agg_window._jdf.queryExecution().optimizedPlan().toString())
