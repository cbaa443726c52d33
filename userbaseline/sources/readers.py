"""Reading stored tables and files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMAND_LABELS = T.StructType(
    [T.StructField("cmd", T.StringType()), T.StructField("label", T.StringType())]
)
COMPANY_KEYS = T.StructType(
    [T.StructField("company_id", T.LongType()), T.StructField("company_key", T.StringType())]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a stored table out over the cores when it has fewer splits than cores.

    For rows that are long work, such as texts. A table of cluster size has more splits than
    cores and is left as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def jdbc_table(
    spark: SparkSession,
    url: str,
    source: str,
    properties: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A database table, or a derived table ``(SELECT …) alias``, over JDBC.

    With ``partition_column`` the read is split into ``partitions`` ranges; without it one
    task reads everything, which only suits dimension tables.
    """
    bounds = (partition_column, lower, upper, partitions)
    if any(b is not None for b in bounds) and any(b is None for b in bounds):
        raise ValueError("partition_column, lower, upper and partitions go together")
    if partition_column is None:
        return spark.read.jdbc(url, source, properties=dict(properties or {}))
    return spark.read.jdbc(
        url,
        source,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties or {}),
    )


def csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header. Types come from ``schema``, or are inferred when it is None."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def labelled_commands(spark: SparkSession, path: str) -> DataFrame:
    """Training texts of the command-reputation model: (cmd, label)."""
    return csv_table(spark, path, COMMAND_LABELS)


def positional_csv(
    spark: SparkSession, path: str, names: Sequence[str], numeric: Sequence[str]
) -> DataFrame:
    """A CSV file whose columns are named by position, whatever its header row says.

    The columns in ``numeric`` become integers; a text that is no number becomes NULL.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)

    def typed(name: str) -> Column:
        return F.col(name).try_cast("int").alias(name) if name in numeric else F.col(name)

    return raw.select(*[typed(n) for n in names])


def company_keys(spark: SparkSession, path: str) -> DataFrame:
    """Decryption keys: (company_id, company_key as hex digits)."""
    return csv_table(spark, path, COMPANY_KEYS)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Pass ``df`` on, or stop when it has no columns or no rows. Looks at one row only."""
    if not df.columns:
        raise ValueError(f"{what}: no columns")
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
