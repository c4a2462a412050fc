"""Incremental landing: new files only, dedup across runs, restart from checkpoint."""

import os
import subprocess
import sys

import pytest

from eventlens.sources import RAW_COLUMNS
from eventlens.session import checkpoint_dir
from eventlens.streaming import finalize_landed, start_landing, start_rejects

HEADER = ",".join(RAW_COLUMNS)


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(("\r\n".join([HEADER, *lines]) + "\r\n").encode())


def test_incremental_landing_dedups_across_runs(spark, tmp_path):
    src, table, ckpt = str(tmp_path / "src"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    a = "A,SF,Retail,10,0.1,1/5/2022,Seed,United States.,5"
    b = "B,NYC,NULL,20,NULL,2/5/2022,Null,Canada,NULL"
    c = "B,NYC,Media,30,0.2,3/5/2022,Seed,Canada,7"
    junk = "C,LA,Retail,NULL,NULL,4/5/2022,Seed,Canada,1"
    write(f"{src}/f1.csv", a, b, a)
    q = start_landing(spark, src, table, ckpt)
    q.awaitTermination()
    assert spark.read.parquet(table).count() == 2
    write(f"{src}/f2.csv", a, c, junk)          # 'a' again in a later file: state drops it
    q = start_landing(spark, src, table, ckpt)  # restart from the checkpoint: f1 is not re-read
    q.awaitTermination()
    landed = spark.read.parquet(table)
    assert landed.count() == 3
    final = {(r.company, r.total_laid_off): (r.industry, r.stage, r.country) for r in
             finalize_landed(spark, table).collect()}
    assert final[("B", 20)] == ("Media", "Unknown", "Canada")
    assert final[("A", 10)] == ("Retail", "Seed", "United States")


def test_rejects_have_a_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/f1.csv", "A,SF,Retail,10,0.1,1/5/2022,Seed,Canada,5", "X" * 60 + ",SF,Retail,11,0.1,1/5/2022,Seed,Canada,5")
    start_landing(spark, src, str(tmp_path / "all"), str(tmp_path / "c0")).awaitTermination()
    start_landing(spark, src, str(tmp_path / "fits"), str(tmp_path / "c1"), max_len=50).awaitTermination()
    start_rejects(spark, src, str(tmp_path / "rejects"), str(tmp_path / "c2"), max_len=50).awaitTermination()
    n = {t: spark.read.parquet(str(tmp_path / t)).count() for t in ("all", "fits", "rejects")}
    assert n == {"all": 2, "fits": 1, "rejects": 1}


SCRIPT = """
import sys
from eventlens import get_session
from eventlens.streaming import start_landing
src, table, ckpt = sys.argv[1:]
spark = get_session("local[2]", 2)
start_landing(spark, src, table, ckpt).awaitTermination()
spark.stop()
"""


def test_restart_in_another_application(spark, tmp_path):
    """Two applications, one after the other, land each file once."""
    src, table, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for i in (1, 2):
        write(f"{src}/f{i}.csv", f"A,SF,Retail,{i},0.1,1/5/2022,Seed,Canada,5", "B,SF,Retail,9,0.1,1/5/2022,Seed,Canada,5")
        subprocess.run([sys.executable, "-c", SCRIPT, src, table, ckpt], check=True, cwd=root, timeout=120, capture_output=True)
    assert sorted(r.total_laid_off for r in spark.read.parquet(table).collect()) == [1, 2, 9]


def test_no_private_scratch_on_a_cluster(tmp_path):
    class Context:
        master = "spark://host:7077"
        set_to = None

        def getCheckpointDir(self):
            return self.set_to

        def setCheckpointDir(self, d):
            self.set_to = d

    class Session:
        def __init__(self, conf):
            self.sparkContext, self.conf = Context(), conf
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session({}))
    assert checkpoint_dir(Session({"spark.checkpoint.dir": "hdfs://nn/ck"})) == "hdfs://nn/ck"
    local = Session({})
    local.sparkContext.master = "local[4]"
    assert os.path.isdir(checkpoint_dir(local))
