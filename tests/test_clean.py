"""Cleaning rules on hand-made landing rows (unit layer)."""

import datetime as dt

import pytest

from eventlens.operators import clean as C
from eventlens.sources import CORRUPT, RAW_COLUMNS, load_raw_csv

RAW_SCHEMA = ", ".join(f"{c} string" for c in RAW_COLUMNS)
NBSP, CR = "\u00a0", "\r"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_SCHEMA)


def r9(company="Acme", location="SF", industry="Retail", total="10", pct="0.1", date="3/6/2023",
       stage="Series B", country="United States", funds="12" + NBSP + CR):
    return (company, location, industry, total, pct, date, stage, country, funds)


def test_typed_projection_rules(spark):
    df = raw(spark,
             r9(company="  Acme ", industry="Crypto Currency", country="United States.", funds="12" + NBSP + CR),
             r9(industry="NULL", stage="Null", country=" Canada  ", date="03/16/2023", funds="NULL" + CR),
             r9(industry=None, stage=None, total="12.0", pct="junk", date="13/45/2023", funds="1" + NBSP + "5"),
             r9(industry="cryptocurrency", country="united states.", total="NULL", pct="NULL", date="NULL"))
    out = [tuple(r) for r in C.typed_projection(df).collect()]
    assert out[0] == ("Acme", "SF", "United States", "Crypto", "Series B", dt.date(2023, 3, 6), 10, 0.1, 12.0)
    assert out[1] == ("Acme", "SF", "Canada", None, "Unknown", dt.date(2023, 3, 16), 10, 0.1, None)
    # real NULL stage stays NULL; '12.0' is not an integer; junk -> NULL; NBSP inside a number is removed
    assert out[2] == ("Acme", "SF", "United States", None, None, None, None, None, 15.0)
    assert out[3][2:4] == ("united states", "Crypto")
    assert out[3][5:8] == (None, None, None)


def test_dedup_runs_on_raw_strings(spark):
    df = raw(spark, r9(), r9(), r9(company="Acme "), r9(industry=None), r9(industry=None))
    assert C.exact_dedup(df).count() == 3          # NULLs compare equal
    clean = C.clean_events(df)
    assert clean.count() == 3                        # 'Acme ' survives dedup (trimmed later)
    assert C.clean_events(df, dedup_after=True).count() == 2


def test_drop_and_impute(spark):
    df = raw(spark,
             r9(company="A", industry="Retail", date="1/1/2022"),
             r9(company="A", industry=None, date="1/2/2022"),
             r9(company="A", industry="Finance", date="1/3/2022"),
             r9(company="B", industry=None),
             r9(company="D", industry="Media", total="NULL", pct="NULL"),   # dropped before imputation
             r9(company="D", industry=None, date="2/2/2022"),
             r9(company=None, industry=None, date="5/5/2022"))
    clean = {(r.company, r.date): r.industry for r in C.clean_events(df).collect()}
    assert clean[("A", dt.date(2022, 1, 2))] == "Finance"           # min of the donors
    assert clean[("B", dt.date(2023, 3, 6))] == "Unknown"
    assert clean[("D", dt.date(2022, 2, 2))] == "Unknown"           # the only donor row was dropped
    assert clean[(None, dt.date(2022, 5, 5))] == "Unknown"          # NULL key never imputes
    assert len(clean) == 6


def test_impute_mode_breaks_ties_by_smallest(spark):
    df = raw(spark, r9(company="A", industry="Zeta", date="1/1/2022"), r9(company="A", industry="Zeta", date="1/2/2022"),
             r9(company="A", industry="Alpha", date="1/3/2022"), r9(company="A", industry=None, date="1/4/2022"),
             r9(company="B", industry="Yak", date="1/1/2022"), r9(company="B", industry="Bee", date="1/2/2022"),
             r9(company="B", industry=None, date="1/3/2022"))
    got = {(r.company, r.date.day): r.industry for r in C.clean_events(df, strategy="mode").collect()}
    assert got[("A", 4)] == "Zeta" and got[("B", 3)] == "Bee"
    got_min = {(r.company, r.date.day): r.industry for r in C.clean_events(df).collect()}
    assert got_min[("A", 4)] == "Alpha"


def test_long_text_is_kept_unless_a_limit_is_asked_for(spark):
    df = raw(spark, r9(company="X" * 51), r9(company="Y" * 50))
    assert {r.company for r in C.clean_events(df).collect()} == {"X" * 51, "Y" * 50}
    assert C.clean_stages(df)["rejects"].count() == 0
    clean, rejects = C.clean_and_rejects(df, 50)
    assert [r.company for r in clean.collect()] == ["Y" * 50]
    assert [r.company for r in rejects.collect()] == ["X" * 51]


def test_every_landing_row_is_accounted_for(spark):
    df = raw(spark, r9(), r9(), r9(), r9(company="X" * 51), r9(company="X" * 51), r9(company="B", total="n/a", pct="NULL"),
             r9(company="C" * 60, total="n/a", pct="NULL"), r9(company="D", industry=None), r9(company="D", industry=None))
    st = C.clean_stages(df, max_len=50)
    n = {k: v.count() for k, v in st.items()}
    duplicates = n["raw"] - n["distinct"]
    assert n["raw"] - duplicates == n["clean"] + n["rejects"] + n["uninformative"] == 5
    audit = {r.stage: r.num_rows for r in C.load_audit(df, max_len=50).collect()}
    assert audit == {"raw": 9, "malformed": 0, "duplicates": 4, "distinct": 5, "rejects": 2, "uninformative": 1, "clean": 2}
    assert list(audit) == list(C.AUDIT_STAGES)
    assert {r.stage: r.num_rows for r in C.load_audit(df.filter("false")).collect()} == dict.fromkeys(C.AUDIT_STAGES, 0)


def test_clean_is_idempotent_on_rows(spark):
    df = raw(spark, r9(), r9(company="B", industry=None), r9(company="B", industry="Retail", date="2/2/2022"))
    once = C.clean_events(df)
    again = C.exact_dedup(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


@pytest.fixture()
def csv_file(tmp_path):
    header = ",".join(RAW_COLUMNS)
    lines = [header,
             f'  Acme ,"SF, CA",Crypto Currency,100,0.1,3/6/2023,Series B,United States.,12{NBSP}',
             'Beta,NYC,Null,NULL,NULL,NULL,Null, Canada ,NULL',
             'Short,Row',
             'Long,a,b,c,d,e,f,g,h,i,j']
    p = tmp_path / "landing.csv"
    p.write_bytes(("\r\n".join(lines) + "\r\n").encode("utf-8"))
    return str(p)


def test_load_raw_csv_crlf_quotes_and_malformed(spark, csv_file):
    df = load_raw_csv(spark, csv_file, keep_corrupt=True)
    got = {r.company: r for r in df.collect()}
    acme = got["  Acme "]
    assert acme.location == "SF, CA"                      # quoted comma stays in the field
    assert acme.funds_raised_millions == "12" + NBSP + CR  # CR of the CRLF stays on the last field
    assert got["Beta"].country == " Canada "
    assert got["Short"][CORRUPT] is not None and got["Long"][CORRUPT] is not None
    assert acme[CORRUPT] is None
    clean = {r.company: r for r in C.clean_events(df.drop(CORRUPT)).collect()}
    assert clean["Acme"].funds_raised_millions == 12.0 and clean["Acme"].country == "United States"
    audit = {r.stage: r.num_rows for r in C.load_audit(df, corrupt_col=CORRUPT).collect()}
    assert audit == {"raw": 4, "malformed": 2, "duplicates": 0, "distinct": 2, "rejects": 0, "uninformative": 1, "clean": 1}
    st = C.clean_stages(df, corrupt_col=CORRUPT)          # half-parsed rows are no data
    assert [r.company for r in st["clean"].collect()] == ["Acme"] and st["malformed"].count() == 2


def test_clean_with_audit_single_pass(spark, tmp_path):
    df = raw(spark, r9(), r9(), r9(company="B", industry=None), r9(company="C", total="NULL", pct="NULL"))
    st, obs = C.clean_with_audit(df)
    st["clean"].write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert obs["clean"].get == {"rows": 2, "rows_with_date": 2, "rows_with_measure": 2, "unknown_industry": 1}


def test_case_insensitive_collation(spark):
    df = raw(spark, r9(company="Acme", industry="Retail", stage="Seed"),
             r9(company="ACME ", industry="Retail", stage="seed "),     # equal under CI + RTRIM
             r9(company="acme", industry="null", date="2/2/2022"))     # token in another case
    binary = C.clean_events(df)
    assert binary.count() == 3
    ci = C.clean_events(df, collation="UTF8_LCASE_RTRIM")
    rows_ = ci.collect()
    assert len(rows_) == 2
    assert {r.industry for r in rows_} == {"Retail"}                 # imputed across case variants
    assert dict(ci.dtypes)["company"] == "string"


def test_numbers_that_no_database_holds_are_junk(spark):
    df = spark.createDataFrame([("Infinity",), ("-inf",), ("NaN",), ("1e400",), ("2.5",), ("x",)], "v string")
    assert [r.v for r in C.safe_numeric(df, "v", "double").collect()] == [None, None, None, None, 2.5, None]
    assert [r.v for r in C.strip_invisible_numeric(df, "v").collect()] == [None, None, None, None, 2.5, None]
    assert [r.v for r in C.safe_numeric(df, "v", "int").collect()] == [None] * 4 + [None, None]
