from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlens import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

CLEAN_SCHEMA = ("company string, location string, country string, industry string, stage string, date date, "
                "total_laid_off int, percentage_laid_off double, funds_raised_millions double, event_id long")


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, app="eventlens-tests",
                    extra={"spark.ui.showConsoleProgress": "false",
                           "spark.sql.autoBroadcastJoinThreshold": "10485760"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def ev(company="A", location="X", country="C1", industry="I1", stage="S1", date="2022-01-15", total=10,
       pct=0.1, funds=100.0, event_id=None):
    d = dt.date.fromisoformat(date) if isinstance(date, str) else date
    return (company, location, country, industry, stage, d, total, pct, funds, event_id)


@pytest.fixture()
def events(spark):
    """Build a clean-schema DataFrame from ev(...) tuples (event_id auto-filled)."""
    def make(*rows):
        rows = [r[:-1] + (i if r[-1] is None else r[-1],) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, CLEAN_SCHEMA)
    return make


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
