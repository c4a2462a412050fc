"""Golden data: the published city aggregates of the map page."""

import json
import os
from decimal import Decimal

from eventlens.operators import geo as G
from eventlens.plans.sinks import export_city_map
from eventlens.sources import country_name_lookup

from .golden_cities import city_rows


def test_country_totals(spark):
    ct = {r.country: r for r in G.country_totals(city_rows(spark)).collect()}
    assert len(ct) == 22 and sum(r.num_cities for r in ct.values()) == 48
    assert sum(r.country_total for r in ct.values()) == 261957
    us = ct["United States"]
    assert us.country_total == 193484 and us.num_cities == 10
    assert us.max_country_total == 193484 and us.max_city_total == 109168


def test_intensity(spark):
    it = {r.country: r.intensity for r in G.intensity(G.country_totals(city_rows(spark)), "country_total").collect()}
    assert it["United States"] == 1.0
    assert abs(it["Germany"] - (6189 / 193484) ** 0.4) < 1e-6


def test_bubble_size(spark):
    b = {r.city: r for r in G.bubble_size(city_rows(spark)).collect()}
    assert b["SF Bay Area"].radius == 28.0 and b["SF Bay Area"].show_label
    t = 939 ** 0.5 / 109168 ** 0.5
    assert abs(b["Austin"].radius - (4 * (1 - t) + 28 * t)) < 1e-6 and not b["Austin"].show_label
    assert b["Vienna"].radius == 28.0  # only city of its country


def test_city_panel_and_bars(spark):
    p = {r.country: r for r in G.city_panel(city_rows(spark)).collect()}
    assert p["Germany"].avg_city_rate == 11.1          # (3.00 + 17.31 + 4.00 + 20.00) / 4 = 11.0775
    assert p["United States"].companies_sum == 508
    bars = {(r.country, r.city): r for r in G.city_bars(city_rows(spark)).collect()}
    assert bars[("Germany", "Walldorf")].pct_of_max == 100 and bars[("Germany", "Walldorf")].bar_rank == 1
    assert bars[("Germany", "Berlin")].pct_of_max == 96   # 2869 / 3000 = 95.6%


def test_harmonize_names(spark):
    df = spark.createDataFrame([("United States of America", 1), ("Russian Federation", 2), ("France", 3)],
                               "country string, n int")
    got = {r.n: r.country for r in G.harmonize_names(df, "country", country_name_lookup(spark)).collect()}
    assert got == {1: "United States", 2: "Russia", 3: "France"}


def test_export_city_map(spark, tmp_path):
    out = str(tmp_path / "map")
    export_city_map(city_rows(spark), out)
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json") for x in open(os.path.join(out, f))]
    by = {d["country"]: d["cities"] for d in lines}
    assert len(by) == 22 and [c["city"] for c in by["Germany"]][:2] == ["Walldorf", "Berlin"]
    assert Decimal(str(by["Austria"][0]["layoff_rate_raw"])) == Decimal("27.0")
