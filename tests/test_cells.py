"""Distinct-count sketches per cell: merged cards against the events themselves."""

from eventlens.operators import cells, geo

from .conftest import ev


def test_cards_of_a_slice_equal_those_of_its_events(events):
    df = events(ev("A", country="C1", date="2022-01-01"), ev("A", country="C2", date="2022-05-01", total=None), ev("B", country="C1", date="2023-01-01", pct=0.0),
                ev("B", country="C1", stage="S2", date="2022-01-01", pct=None), ev(None, country="C3", date=None), ev("C", country=None, industry=None, stage=None))
    table = cells.event_cells(df)
    assert table.count() == 6
    for pick in ({}, {"years": [2022]}, {"countries": ["C1"]}, {"years": [2022], "countries": ["C1"], "stages": ["S2"]}, {"industries": ["none"]}):
        want = geo.kpi_cards(geo.slice_events(df, **pick)).first()
        got = cells.cell_cards(table, **pick).first()
        assert (got.total_laid_off, got.avg_layoff_rate, got.num_companies) == (want.total_laid_off, want.avg_layoff_rate, want.num_companies)


def test_every_value_of_every_slicer(events):
    df = events(ev("A"), ev("B", country=None), ev("A", country="C2", stage=None, date=None))
    got = {(r.slicer, r.value): (r.num_events, r.exact_companies, r.within_bound) for r in cells.sketch_check(cells.event_cells(df), df).collect()}
    assert got == {("year", "2022"): (2, 2, True), ("year", None): (1, 1, True), ("country", "C1"): (1, 1, True), ("country", None): (1, 1, True),
                   ("country", "C2"): (1, 1, True), ("industry", "I1"): (3, 2, True), ("stage", "S1"): (2, 2, True), ("stage", None): (1, 1, True)}


def test_merged_sketches_stay_within_their_bound(spark):
    rows = spark.range(200_000).selectExpr(
        "concat('c', id % 60000) AS company", "concat('L', id % 3) AS location", "concat('C', id % 7) AS country", "concat('I', id % 11) AS industry",
        "concat('S', id % 5) AS stage", "date_add(date'2020-01-01', cast(id % 1000 as int)) AS date", "1 AS total_laid_off",
        "0.5D AS percentage_laid_off", "1D AS funds_raised_millions", "id AS event_id")
    out = cells.sketch_check(cells.event_cells(rows), rows)
    assert out.count() == 3 + 7 + 11 + 5 and out.where("not within_bound").count() == 0
    assert cells.event_cells(rows.where("false")).count() == 0
