"""Sorted output.

Order is a matter of the files that are handed on, and not of the operators: rows are dealt by ranges of the
key and sorted inside each range, so files follow one another in order and none of their ranges overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: rows of a file, about
ROWS_PER_FILE = 2_000_000


def write_sorted(rows: DataFrame, path: str, by: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``rows`` as Parquet files in the order of ``by``, nulls first. Rows of equal keys share a file.

    The rows are counted first; ranges come from a sample, so sizes are near ``rows_per_file``.
    """
    files = max(1, -(-rows.count() // rows_per_file))
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(path)


def in_written_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows with ``place``, their number from 0 in the order of files and of rows in them."""
    stored = spark.read.parquet(path)
    named = stored.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = named.groupBy("file").agg(F.count(F.lit(1)).alias("size"))  # a row for each file
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return named.join(starts, "file").select(*stored.columns, (F.col("start") + F.col("row")).alias("place"))
