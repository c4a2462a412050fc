"""Delimited-text landing: read raw event files into all-string rows.

The landing table is all strings on purpose: typing happens in the cleaning
step, where bad values become NULL instead of failing the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .fixtures import RAW_COLUMNS

CORRUPT = "_corrupt_record"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def load_raw_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA,
                 quote: str = '"', encoding: str = "UTF-8", line_sep: str = "\n",
                 keep_corrupt: bool = False) -> DataFrame:
    """Header row skipped, comma-separated, rows split on LF only, UTF-8.

    Splitting on LF keeps a CR of CRLF files on the last field, exactly like a
    bulk load with an LF row terminator; `strip_invisible_numeric` removes it.
    Quoted fields may contain commas. Uncompressed (or bzip2) landing files
    are split across tasks; gzip files are read one task per file. Rows with
    too few or too many fields
    keep their text in ``_corrupt_record`` (PERMISSIVE mode) when
    ``keep_corrupt`` is set. Never infers a schema.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    df = (spark.read.schema(full)
          .option("header", True)
          .option("encoding", encoding)
          .option("lineSep", line_sep)
          .option("quote", quote)
          .option("escape", quote)
          .option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .csv(path))
    return df if keep_corrupt else df.drop(CORRUPT)


def write_raw_csv(df: DataFrame, path: str, line_sep: str = "\n") -> None:
    """Write landing rows as a headed CSV folder (one file per partition)."""
    (df.write.mode("overwrite")
       .option("header", True)
       .option("lineSep", line_sep)
       .option("quote", '"')
       .option("escape", '"')
       # keep outer spaces: the cleaning rules, not the writer, decide on them
       .option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False)
       .csv(path))
