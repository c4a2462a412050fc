"""Batch jobs: landing CSV -> clean table -> reports read from the table."""

from pyspark.sql import functions as F

from eventlens.operators import clean as C
from eventlens.plans.jobs import REPORTS, clean_job, report_job
from eventlens.roles import Roles
from eventlens.sources import raw_view, short_rows, write_raw_csv

from .conftest import SF_SMALL


def test_clean_then_report(spark, tmp_path):
    landing, table, out = str(tmp_path / "landing"), str(tmp_path / "table"), str(tmp_path / "out")
    raw = raw_view(spark, SF_SMALL)
    write_raw_csv(raw, landing + "/rows")
    write_raw_csv(short_rows(spark, SF_SMALL), landing + "/short")
    metrics = clean_job(spark, landing + "/{rows,short}", table, max_len=50)
    audit = metrics["audit"]
    assert audit["raw"] == raw.count() + audit["malformed"] and audit["malformed"] > 0 and audit["rejects"] > 0
    expected = C.clean_and_rejects(raw, 50)[0].count()
    assert metrics["clean"]["rows"] == expected == audit["clean"] == spark.read.parquet(table).count()
    assert spark.read.parquet(table + "_rejects/too_long").count() == audit["rejects"] == metrics["rejects"]["rows"]
    assert spark.read.parquet(table + "_rejects/malformed").count() == audit["malformed"] == metrics["malformed"]["rows"]
    assert metrics["seconds"] > 0
    spark.read.parquet(table).withColumn("event_id", F.monotonically_increasing_id()).write.parquet(table + "_ids")
    done = report_job(spark, table + "_ids", out, r=Roles(tie_break=("event_id",)))  # every report, from a written table
    assert done == list(REPORTS)
    assert spark.read.parquet(f"{out}/zscore").count() > 0
    assert spark.read.parquet(f"{out}/kpi_summary").count() == 8
