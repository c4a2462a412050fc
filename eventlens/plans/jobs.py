"""Batch jobs: clean once, then answer every report from the written table.

    python -m eventlens.plans.jobs clean  <landing_dir> <table_dir>
    python -m eventlens.plans.jobs report <table_dir> <out_dir> [name ...]

The clean job reads the landing text once: its distinct rows, typed and counted,
are staged in the shared scratch folder, and the event table (partitioned by
event year), the rejects and the audit come from there. Reports read that table — not the landing text — so the dedup and
imputation shuffles run once per load, and year slicers prune folders. Each
report is written as its own parquet folder; rerunning a job overwrites its
output, so a failed or repeated run is harmless.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN

from ..operators import analyze as A
from ..operators import breakdown as K
from ..operators import clean as C
from ..operators import geo as G
from ..operators import profile as P
from ..operators import trend as T
from ..roles import DEFAULT, Roles
from ..session import scratch_path
from ..sources import CORRUPT, load_raw_csv
from .sinks import write_event_table

Report = Callable[[DataFrame, Roles], DataFrame]

REPORTS: dict[str, Report] = {
    "null_profile": lambda df, r: P.null_profile(df),
    "year_coverage": P.year_coverage,
    "kpi_summary": P.kpi_summary,
    "workforce_estimate": P.workforce_estimate,
    "yearly_totals": T.yearly_totals,
    "yoy_change": T.yoy_change,
    "mom_change": T.mom_change,
    "rolling_total": T.rolling_total,
    "annual_share": T.annual_share,
    "peak_month": T.peak_month,
    "peak_root_cause": T.peak_root_cause,
    "industry_breakdown": K.industry_breakdown,
    "stage_breakdown": K.stage_breakdown,
    "stage_year_cohort": K.stage_year_cohort,
    "top_entities": K.top_entities,
    "shutdowns": K.shutdowns,
    "outliers_vs_mean": K.outliers_vs_mean,
    "top_k_per_group": K.top_k_per_group,
    "country_breakdown": K.country_breakdown,
    "city_breakdown": K.city_breakdown,
    "pearson": lambda df, r: K.correlation_strength(K.pearson(df, r.total, r.funds)),
    "pivot_share": A.share_long,
    "multi_round": A.multi_round,
    "cross_matrix": A.cross_matrix,
    "percentiles": lambda df, r: A.percentiles(df, r.total),
    "segment_stats": A.segment_stats,
    "segment_share": A.segment_share,
    "segment_by_country": A.segment_by_country,
    "segment_by_year": A.segment_by_year,
    "zscore": A.zscore,
    "funding_paradox": A.funding_paradox,
    "riskiest_stage": A.riskiest_stage,
    "survival_rate": A.survival_rate,
    "country_panel": G.country_panel,
    "kpi_cards": G.kpi_cards,
    "share_of_events": lambda df, r: K.share_of_events(df, r.industry),
    "pivot_shift": A.shift_long,
    "distress_screen": lambda df, r: A.distress_screen(A.multi_round(df, r)),
    "dominant_cells": lambda df, r: A.dominant_cells(A.cross_matrix(df, r)),
    "adaptive_threshold": A.adaptive_threshold,
    "segment_breakdown_huge": A.segment_breakdown_huge,
    "segment_breakdown_small": A.segment_breakdown_small,
    "outlier_screen": lambda df, r: A.outlier_screen(A.zscore(df, r)),
    "funded_shutdowns": A.funded_shutdowns,
    "city_map_rows": G.city_map_rows,
    "country_totals": lambda df, r: G.country_totals(G.city_map_rows(df, r)),
}


def clean_job(spark: SparkSession, landing: str, table: str, r: Roles = DEFAULT, rejects: str | None = None,
              max_len: int | None = None, **kw) -> dict:
    """Landing CSV folder -> clean event table; returns the load metrics.

    Malformed rows (wrong number of fields) and rows over ``max_len`` never
    reach the table: they are written to ``<rejects>/malformed`` and
    ``<rejects>/too_long`` (default: ``<table>_rejects``) and counted. The
    metrics hold the counts of `load_audit` and the seconds of the load.
    """
    began = time.monotonic()
    staging = scratch_path(spark, "load", uuid.uuid4().hex)
    collation = kw.get("collation")
    groups, load = C.staged_load(load_raw_csv(spark, landing, keep_corrupt=True), r, CORRUPT, max_len, collation)
    groups.write.parquet(staging)  # the only read of the landing text; the audit fills on the way
    stages = C.from_staged(spark.read.schema(groups.schema).parquet(staging), r, max_len, **kw)
    written = Observation("eventlens_clean")
    clean = stages["clean"].observe(written, F.count(F.lit(1)).alias("rows"), F.count(F.col(r.date)).alias("rows_with_date"),
                                    F.count(F.col(r.total)).alias("rows_with_measure"),
                                    F.count_if(F.col(r.industry) == UNKNOWN).alias("unknown_industry"))
    write_event_table(clean, table, r)
    rejects = rejects or f"{table.rstrip('/')}_rejects"
    stages["malformed"].withColumnRenamed("_record", CORRUPT).write.mode("overwrite").parquet(f"{rejects}/malformed")
    stages["rejects"].write.mode("overwrite").parquet(f"{rejects}/too_long")
    audit = {s: load.get[s] for s in C.AUDIT_STAGES}
    return {"audit": audit, "clean": written.get, "rejects": {"rows": audit["rejects"]}, "malformed": {"rows": audit["malformed"]},
            "seconds": round(time.monotonic() - began, 3)}


def report_job(spark: SparkSession, table: str, out_dir: str, names=None, r: Roles = DEFAULT) -> list[str]:
    """Compute the named reports (all by default) from the clean table."""
    events = spark.read.parquet(table)
    done = []
    for name in names or REPORTS:
        REPORTS[name](events, r).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
        done.append(name)
    return done


def main(argv: list[str]) -> None:
    from ..session import get_session

    spark = get_session()
    if argv[:1] == ["clean"] and len(argv) == 3:
        print(clean_job(spark, argv[1], argv[2]))
    elif argv[:1] == ["report"] and len(argv) >= 3:
        print(report_job(spark, argv[1], argv[2], argv[3:] or None))
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
