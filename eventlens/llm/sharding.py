"""Sharding by jump consistent hashing.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014):
a key walks through the shard counts at which it would have moved; no ring
table is kept, and when a shard is appended a key either stays or moves to the
new shard. The shard of a row follows from its key and the shard count alone.

Defined cases: a null key counts as key 0; a null text has size 1 and crc32 0;
repeated rows and equal keys share a shard and take consecutive slots; an empty
table gives an empty table. Only the key and text columns are read, so further
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_total, table
from .textops import mix

STEP = np.uint64(2862933555777941757)  # fixed value of the published algorithm


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys walking together."""
    key = key.astype(np.uint64, copy=True)
    at, nxt = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        k = key[live] * STEP + np.uint64(1)
        key[live] = k
        nxt[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def shard_of(shards: int):
    """Pandas UDF: long key -> shard. Keys are spread first, so runs of ids cause no pattern."""
    @F.pandas_udf(T.IntegerType())
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump(mix(key.to_numpy(dtype=np.int64).view(np.uint64)), shards).astype(np.int32))
    return of


def _key(df: DataFrame, col: str):
    whole = isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(F.col(col).cast("long") if whole else F.xxhash64(F.col(col)), F.lit(0).cast("long"))


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (bytes + 1), text_crc32, law, shard, slot in the shard, grown_shard (one shard more).

    Slots count a shard's rows by (id, crc, size) from 0 without gaps. They
    come from a range-partitioned running total, so a shard of any size is
    numbered by many tasks, and the text itself is never shuffled.
    """
    bytes_ = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = _key(docs, id_col)
    df = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
                     F.crc32(bytes_).alias("text_crc32"), F.lit("key").alias("law"), key.alias("_key"))
    df = (df.withColumn("shard", shard_of(shards)("_key")).withColumn("grown_shard", shard_of(shards + 1)("_key"))
          .drop("_key").withColumn("_one", F.lit(1).cast("long")))
    df = running_total(df, ["shard"], ["doc_id", "text_crc32", "size"], "_one", "slot")
    return df.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write the documents, one folder per shard (`shard=N`); each shard is written by `files_per_shard` tasks."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    out = docs.withColumn("shard", shard_of(shards)(_key(docs, id_col)))
    out.repartition(shards * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)


def op10_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
