"""The commands of a session or a day as one text, in bounded pieces.

A text is the lower-cased, non-null commands in the order (ts, cmd_id), joined by one space. A
text of up to ``chunk_chars`` characters is one row. A longer one is laid out over several
rows of at most that length, without any task ever holding it whole: the rows are range-sorted
over the cluster, so a group with a large share of all rows spreads over many partitions, and
every command's offset is its partition's start plus a running sum inside the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from userbaseline.session import cut

CHUNK_CHARS = 65_536
SEPARATOR = " "


def _pieces(commands: DataFrame, keys: Sequence[str]) -> DataFrame:
    return commands.filter(F.col("cmd").isNotNull()).select(
        *keys, "ts", "cmd_id", F.lower("cmd").alias("cmd")
    )


def text_sizes(commands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Characters of each group's text, summed up before and after the shuffle."""
    return (
        _pieces(commands, keys)
        .groupBy(*keys)
        .agg((F.sum(F.char_length("cmd") + len(SEPARATOR)) - len(SEPARATOR)).alias("chars"))
    )


def _joined(entries: Column) -> Column:
    """Concatenate (position…, cmd) structs in their order."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e.getField("cmd")), SEPARATOR)


def short_texts(commands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, text). Only for groups whose size has been checked."""
    return (
        _pieces(commands, keys)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("ts", "cmd_id", "cmd")).alias("entries"))
        .select(*keys, _joined(F.col("entries")).alias("text"))
    )


def long_texts(commands: DataFrame, keys: Sequence[str], chunk_chars: int) -> DataFrame:
    """(keys, chunk_no, text) for groups of any size."""
    keys = list(keys)
    spread = _pieces(commands, keys).repartitionByRange(*keys, "ts", "cmd_id")
    # fixed on storage: a partition number must not change between the two uses below
    placed = cut(spread.withColumn("part", F.spark_partition_id()))
    step = F.char_length("cmd") + len(SEPARATOR)
    before_part = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "part")
        .agg(F.sum(step).alias("part_chars"))
        .withColumn("part_start", F.coalesce(F.sum("part_chars").over(before_part), F.lit(0)))
        .drop("part_chars")
    )
    before_row = (
        W.partitionBy(*keys, "part").orderBy("ts", "cmd_id").rowsBetween(W.unboundedPreceding, -1)
    )
    # every command is preceded by a separator; the first one's lies at −1 and is cut off
    lead = len(SEPARATOR)
    located = (
        placed.withColumn("in_part", F.coalesce(F.sum(step).over(before_row), F.lit(0)))
        .join(starts, [*keys, "part"])
        .select(
            *keys,
            (F.col("part_start") + F.col("in_part") - lead).alias("at"),
            F.concat(F.lit(SEPARATOR), "cmd").alias("piece"),
        )
    )
    begin = F.greatest(F.col("at"), F.lit(0))
    end = F.col("at") + F.char_length("piece")
    numbers = F.sequence(F.floor(begin / chunk_chars), F.floor((end - 1) / chunk_chars))
    low = F.greatest(begin, F.col("chunk_no") * chunk_chars)
    high = F.least(end, (F.col("chunk_no") + 1) * chunk_chars)
    cut_up = (
        located.filter(end > begin)
        .withColumn("chunk_no", F.explode(numbers))
        .select(
            *keys,
            "chunk_no",
            low.alias("low"),
            F.substring(
                F.col("piece"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int")
            ).alias("cmd"),
        )
    )
    return (
        cut_up.groupBy(*keys, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("low", "cmd"))).alias("entries"))
        .select(*keys, "chunk_no", F.array_join(F.col("entries.cmd"), "").alias("text"))
    )


def command_text(
    commands: DataFrame, keys: Sequence[str], chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """(keys, chunk_no, text) for every group, short or long; chunks are numbered from 0.

    Each group goes its own way by its own size: whether others are long changes nothing for a short one.
    """
    keys = list(keys)
    long_keys = cut(text_sizes(commands, keys).filter(F.col("chars") > chunk_chars).select(*keys))
    short = short_texts(commands.join(long_keys, keys, "left_anti"), keys)
    short = short.select(*keys, F.lit(0).cast("long").alias("chunk_no"), "text")
    if long_keys.isEmpty():  # no rows to add
        return short
    return short.unionByName(long_texts(commands.join(long_keys, keys, "left_semi"), keys, chunk_chars))
