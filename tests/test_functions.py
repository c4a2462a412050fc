"""Column helpers: integer average truncation, exact rounding, labels."""

from decimal import Decimal

from pyspark.sql import functions as F

from eventlens.functions import int_avg, pct_ratio, ratio, safe_div, scaled, segment, segment_labels, severity, strength


def test_int_avg_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-4,), (-3,), (None,)], "x int")
    assert df.agg(int_avg("x")).first()[0] == -3  # -7 / 2 = -3.5 -> -3
    df = spark.createDataFrame([(4,), (3,)], "x int")
    assert df.agg(int_avg("x")).first()[0] == 3
    empty = spark.createDataFrame([(None,)], "x int")
    assert empty.agg(int_avg("x")).first()[0] is None


def test_ratio_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (285, 1000), (1, 3), (5, 0), (None, 3)], "n long, d long")
    got = [r[0] for r in df.select(ratio("n", "d", 2)).collect()]
    assert got == [0.13, -0.13, 0.29, 0.33, None, None]
    assert df.select(pct_ratio("n", "d")).first()[0] == Decimal("12.5")


def test_safe_div_and_scaled(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1711.56, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 855.78]
    assert [r[0] for r in df.select(scaled("a", 2)).collect()] == [100, 171156]


def test_labels(spark):
    assert segment_labels(3000) == ("Small (<3,000)", "Huge (≥3,000)")
    df = spark.createDataFrame([(2999,), (3000,), (None,)], "t int")
    assert [r[0] for r in df.select(segment("t")).collect()] == ["Small (<3,000)", "Huge (≥3,000)", "Small (<3,000)"]
    z = spark.createDataFrame([(4.0,), (-3.2,), (2.0,), (1.0,), (0.5,), (None,)], "z double")
    assert [r[0] for r in z.select(severity("z")).collect()] == [
        "Extreme Outlier", "Strong Outlier", "Unusual", "Above Average", "Normal", "Normal"]
    r = spark.createDataFrame([(0.29,), (-0.3,), (0.6,), (None,)], "r double")
    assert [x[0] for x in r.select(strength("r")).collect()] == ["weak", "moderate", "strong", None]


def test_null_token_is_case_insensitive(spark):
    from eventlens.functions import null_token, token_to_label
    df = spark.createDataFrame([("NULL",), ("Null",), ("null",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(null_token("s")).collect()] == [None, None, None, None, "x"]
    assert [r[0] for r in df.select(token_to_label("s")).collect()] == ["Unknown"] * 3 + [None, "x"]
    _ = F


def test_exact_sums_and_ratios_do_not_overflow_bigint(spark):
    from decimal import Decimal as D
    # sums over ~10^12 rows of cents or micro-units exceed 9.2e18; ratio multiplies by 2 * 10^scale
    df = spark.createDataFrame([(D(9 * 10 ** 18), D(3 * 10 ** 18))], "n decimal(38,0), d decimal(38,0)")
    assert df.select(ratio("n", "d", 4)).first()[0] == 3.0
    big = spark.range(3).select(F.lit(5e15).alias("x"))
    assert big.agg(F.sum(scaled("x", 6))).first()[0] == D(15 * 10 ** 21)
