"""Incremental landing with Structured Streaming.

The batch path reloads the whole landing folder each time. This path picks up
only new files: a file-source stream of raw rows -> exact dedup across all
batches (streaming state, hash-partitioned over the cluster, kept in the
checkpoint) -> the per-row cleaning rules -> rows that fit and carry a measure
are appended to a parquet table. Peer imputation needs every row of an entity,
so it stays a batch step over the landed table (`finalize_landed`).

Restarts are exactly-once: the file source and the parquet sink record their
progress in the checkpoint folder. Its path is a required argument: it must be
the same in every application that continues the load, and each query needs
one of its own. The dedup state holds one key per distinct row ever seen.

No row is lost to a length limit: without ``max_len`` there is none; with it,
`start_landing` and `start_rejects` are two queries over the same files, one
appending the rows that fit, the other the rows that do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as C
from ..roles import DEFAULT, Roles
from ..sources.csv import RAW_SCHEMA
from ..sources.fixtures import RAW_COLUMNS


def read_landing_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw landing rows from new CSV files in ``src_dir`` (same parsing rules
    as `load_raw_csv`: header, LF rows, quotes, outer spaces kept)."""
    r = (spark.readStream.schema(RAW_SCHEMA)
         .option("header", True)
         .option("encoding", "UTF-8")
         .option("lineSep", "\n")
         .option("quote", '"')
         .option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(src_dir)


def _typed(raw_stream: DataFrame, r: Roles) -> DataFrame:
    return C.typed_projection(raw_stream.select(*RAW_COLUMNS).dropDuplicates(list(RAW_COLUMNS)), r)


def landed_rows(raw_stream: DataFrame, r: Roles = DEFAULT, max_len: int | None = None) -> DataFrame:
    """Streaming transformation: dedup on the raw strings, typed projection,
    rows within ``max_len`` (all without it) that carry a measure."""
    typed = _typed(raw_stream, r)
    fits = typed if max_len is None else typed.filter(~C.too_long(r, max_len))
    return C.drop_uninformative(fits, (r.total, r.pct))


def rejected_rows(raw_stream: DataFrame, max_len: int, r: Roles = DEFAULT) -> DataFrame:
    """The deduplicated, typed rows with a text value over ``max_len`` characters."""
    return _typed(raw_stream, r).filter(C.too_long(r, max_len))


def _start(rows: DataFrame, table_path: str, checkpoint: str, available_now: bool,
           processing_time: str | None) -> StreamingQuery:
    w = (rows.writeStream
         .format("parquet")
         .outputMode("append")
         .option("path", table_path)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def start_landing(spark: SparkSession, src_dir: str, table_path: str, checkpoint: str,
                  r: Roles = DEFAULT, available_now: bool = True,
                  processing_time: str | None = None, max_len: int | None = None) -> StreamingQuery:
    """Start the incremental landing query (append to parquet at ``table_path``).

    ``available_now`` processes every file present and stops (a scheduled
    incremental load); otherwise it keeps running with ``processing_time``.
    With ``max_len``, run `start_rejects` as well.
    """
    return _start(landed_rows(read_landing_stream(spark, src_dir), r, max_len), table_path, checkpoint,
                  available_now, processing_time)


def start_rejects(spark: SparkSession, src_dir: str, table_path: str, checkpoint: str, max_len: int,
                  r: Roles = DEFAULT, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start the query that appends the rows over ``max_len`` to parquet at ``table_path``."""
    return _start(rejected_rows(read_landing_stream(spark, src_dir), max_len, r), table_path, checkpoint,
                  available_now, processing_time)


def finalize_landed(spark: SparkSession, table_path: str, r: Roles = DEFAULT, strategy: str = "min") -> DataFrame:
    """Batch step over the landed table: peer imputation and the Unknown label."""
    landed = spark.read.parquet(table_path)
    return C.label_unknown(C.impute_from_peer(landed, r.company, r.industry, strategy), r.industry)
