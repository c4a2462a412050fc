"""Exact percentiles as one lazy plan: a sketch brackets every rank, one counting pass inside the brackets finds it.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here

1. a quantile sketch per group (bounded state, one scan) gives, for each
   percentile, two values between which its rank must lie;
2. a second scan counts what lies between brackets as one number each and, in
   a bracket, the rows of each value; both are combined map-side;
3. a bracket's counts are summed by bins (at most `bins` of them), the bins that
   hold a wanted rank are found by a running sum over bins, and only their
   values are put in order.

So the events are read twice, whatever the number of percentiles and groups,
and no window sees more than bins, or the values of one bin of a bracket that
holds 4 / `accuracy` of the rows. The counts are exact: should a rank lie
outside its bracket, the plan fails rather than give another value.

Order and interpolation are defined for every double: -Infinity, finite values,
Infinity, NaN. Between two equal values, or at a whole rank, a percentile is
that value; next to a NaN it is NaN; from -Infinity to a finite value
-Infinity, from a finite value to Infinity Infinity, from -Infinity to Infinity
NaN; else the linear interpolation.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch errs by at most 1 / ACCURACY of the rows; brackets reach 2 / ACCURACY to both sides.
ACCURACY = 10_000
BINS = 4096
_MOST = sys.float_info.max


def _between(lo: Column, hi: Column, part: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return (F.when((part == 0) | (lo == hi), lo).when(F.isnan(hi), nan)
            .when(lo == -inf, F.when(hi == inf, nan).otherwise(-inf)).otherwise(lo + (hi - lo) * part))


def _bracketed(base: DataFrame, keys: list[str], qs: list[float], accuracy: int) -> DataFrame:
    """`base` with `_b`: [lo, hi, lo, hi, ...], one pair per percentile, from a sketch of the row's group.

    Groups are few (size segments): their brackets are one array of one row.
    """
    step = 2.0 / accuracy
    ends = [x for q in qs for x in (max(q - step, 0.0), min(q + step, 1.0))]
    sketch = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_h", ends, accuracy).alias("_p"))
    wide = F.col("_n") < 4 * accuracy  # one row is then more of the group than the margin

    def end(i: int, q: float) -> Column:
        low = i % 2 == 0
        least = F.lit(-_MOST if low else _MOST)
        return least if (q <= 0.0 if low else q >= 1.0) else F.when(wide, least).otherwise(F.get("_p", F.lit(i)))

    found = sketch.select(*keys, F.array(*[end(i, q) for i, q in enumerate(ends)]).alias("_b"))
    if not keys:
        return base.withColumn("_b", found.scalar())
    every = found.groupBy().agg(F.collect_list(F.struct("_g", "_b"))).scalar()
    of_group = F.get(F.filter("_every", lambda x: x["_g"].eqNullSafe(F.col("_g"))), F.lit(0))
    return base.withColumn("_every", every).withColumn("_b", of_group["_b"]).drop("_every")


def quantiles(df: DataFrame, value: str, qs, group: str | None = None, accuracy: int = ACCURACY, bins: int = BINS) -> DataFrame:
    """One row per group with non-NULL values: ([group,] n, values), ``values`` the interpolated percentile of each q (like percentile_cont)."""
    keys, own = ([], []) if group is None else (["_g"], [F.col(group).alias("_g")])
    base = df.select(*own, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    held = F.when(F.isnan("_v"), F.lit(_MOST)).otherwise(F.greatest(F.least("_v", F.lit(_MOST)), F.lit(-_MOST)))
    base = base.withColumn("_h", held)  # the sketch and the bins see finite values only, in the same order
    order = sorted(set(qs))
    rows = _bracketed(base, keys, order, accuracy)

    # place 0, 2, 4, ... before, between and after the brackets; 1, 3, ... in a bracket (the first that holds the value)
    h, place, bin_ = F.col("_h"), None, None
    for i in range(len(order)):
        lo, hi = F.get("_b", F.lit(2 * i)), F.get("_b", F.lit(2 * i + 1))
        share = F.coalesce(F.try_divide(h / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))  # halves: no overflow
        at = F.least(F.floor(share * bins), F.lit(bins - 1))
        place = F.when(h < lo, 2 * i) if place is None else place.when(h < lo, 2 * i)
        place = place.when(h <= hi, 2 * i + 1)
        bin_ = F.when(h < lo, F.lit(None)) if bin_ is None else bin_.when(h < lo, F.lit(None))
        bin_ = bin_.when(h <= hi, at)
    rows = rows.select(*keys, "_v", place.otherwise(2 * len(order)).alias("_place"), F.coalesce(bin_, F.lit(-1)).alias("_bin"))
    cells = rows.groupBy(*keys, "_place", "_bin", F.when(F.col("_bin") >= 0, F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))

    here, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_place", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(*keys, "_place", "_bin").agg(F.sum("_c").alias("_c"))  # at most (bins + 1) x percentiles + 1 rows per group
    sums = sums.select(*keys, "_place", "_bin", "_c", F.sum("_c").over(here).alias("_n"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    spot = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.array(*[f(spot(q)).cast("long") for q in order for f in (F.floor, F.ceil)]))
    held_ranks = F.filter(ranks, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_c")))
    hits = sums.withColumn("_ks", held_ranks).filter(F.size("_ks") > 0)
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("array<bigint>")
    hits = hits.select(*[F.col(k).alias(f"{k}2") for k in keys], F.col("_place").alias("_place2"), F.col("_bin").alias("_bin2"), "_n", "_before",
                       F.when(F.col("_bin") >= 0, F.col("_ks")).otherwise(lost).alias("_ks"))

    cond = (F.col("_place") == F.col("_place2")) & (F.col("_bin") == F.col("_bin2"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}2"))
    near = Window.partitionBy(*keys, "_place", "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = cells.join(hits, cond).withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(near), F.lit(0)))
    held_ranks = F.filter("_ks", lambda k: (k >= F.col("_at")) & (k < F.col("_at") + F.col("_c")))
    found = values.select(*keys, "_n", "_x", F.explode(held_ranks).alias("_k"))
    found = found.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))  # two ranks per percentile
    get = lambda f, q: F.element_at("_m", f(spot(q)).cast("long"))
    out = F.array(*[_between(get(F.floor, q), get(F.ceil, q), spot(q) - F.floor(spot(q))) for q in qs])
    return found.select(*([F.col("_g").alias(group)] if keys else []), F.col("_n").alias("n"), out.alias("values"))
