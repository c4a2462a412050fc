"""Helpers shared by the operators: running totals, connected components, table paths."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Edges of a connected-components round that one task writes.
EDGES_A_FILE = 250_000
#: Edges of which a connected-components round lets go what the last round shuffled.
EDGES_RELEASED = 50_000
#: Seconds that `release` waits at most for Python to tell the JVM what it let go.
RELEASE_S = 5


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, so the result does not depend on a locale or Unicode version."""
    return F.translate(c, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder (never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which may be long after
    a phase has ended; here both collectors run once between phases. Python
    tells the JVM of frames that it let go from a thread that looks for them
    once a second: the JVM's collector waits for that, else they all stay.
    """
    gc.collect()
    told, end = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None), time.monotonic() + RELEASE_S
    while told and time.monotonic() < end:
        time.sleep(0.05)
    time.sleep(0.05)  # for the last one, which has left the queue already
    spark.sparkContext._jvm.System.gc()


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group that come before this one.

    Rows are dealt by ranges of (group, order), so a group of any size spreads
    over many tasks: each range is summed alone and gets the total of the
    ranges before it. Only one row per (group, range) meets in the window over
    totals. Nulls in the group or order columns sort first and count as values.
    The frame is cut (checkpointed) after the range exchange, because the two
    later passes must see the same ranges.
    """
    r = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    totals = r.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    names = [f"_g{i}" for i in range(len(group))]
    totals = totals.select(*[F.col(g).alias(n) for g, n in zip(group, names)], F.col("_part").alias("_p"), "_before")
    here = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    cond = F.col("_part") == F.col("_p")
    for g, n in zip(group, names):
        cond = cond & F.col(g).eqNullSafe(F.col(n))
    return (r.join(totals, cond).withColumn(out, F.col("_here") + F.col("_before"))
            .drop("_part", "_p", "_before", "_here", *names))


def _settled(e: DataFrame) -> bool:
    """Every b has one a, and no a is a b: the edges (a < b) are components already."""
    ends = e.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("a", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (node, root), root the smallest node.

    Large-star / small-star rounds: every round is two grouped minima joined
    to the edges, so no component is ever gathered in one task, and the edge
    count never grows. A node with very many neighbours is combined map-side
    in the minimum and split by AQE in the join. Each round is cut to the
    shared folder, so losing an executor repeats one round at most. What the
    rounds before shuffled is released, unless the edges are few.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    del edges
    n = e.count()
    files = 1 + n // EDGES_A_FILE  # edges never grow: few edges need few tasks and files
    e = e.coalesce(files)

    def star(both: DataFrame, nodes_of: DataFrame, small: bool) -> DataFrame:
        m = nodes_of.groupBy("u").agg(F.min("v").alias("m"))
        m = m.withColumn("m", F.least("u", "m")).withColumnRenamed("u", "_u")
        j = both.join(m, F.col("u") == F.col("_u"))
        if small:
            return (j.select(F.col("v").alias("x"), "m").unionByName(m.select(F.col("_u").alias("x"), "m"))
                    .where("x <> m").distinct())
        return j.where("v > u").select(F.col("v").alias("x"), "m").distinct()

    for _ in range(max_rounds):
        if n >= EDGES_RELEASED:
            release(spark)
        if _settled(e):
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        down = star(both, both, small=False).select(F.col("x").alias("u"), F.col("m").alias("v"))
        e = cut(star(down, down, small=True).select(F.col("m").alias("a"), F.col("x").alias("b")).coalesce(files))
        del both, down
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
