"""Joins whose heavy keys are dealt over copies of the small side.

For facts whose skew Spark cannot split by itself, such as joins with the facts on the outer side or below an
aggregate that needs the join's partitioning. Keys are counted (combined in the map tasks); a key with
more than ``heavy_rows`` facts gets so many copies of its rows on the other side that each copy meets about
that many facts. Which copy a fact meets follows from a hash of the fact, so a task that is run again
gives the same rows. Other keys keep their one copy, and no fact is repeated or left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.session import cut

HEAVY_ROWS = 5_000_000
#: so many keys at most count as heavy: their table is broadcast
MOST_HEAVY = 100_000
_COPIES, _COPY = "_copies", "_copy"


def heavy_keys(facts: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key, copies) of the keys with more than ``heavy_rows`` rows, the key NULL included.

    Where more than ``MOST_HEAVY`` keys could be heavy the limit is raised to the rows' number over that.
    """
    counts = cut(facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(heavy_rows, -(-total // MOST_HEAVY))
    return counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias(_COPIES))


def dealt_join(
    facts: DataFrame, side: DataFrame, key: str, how: str = "inner", heavy_rows: int = HEAVY_ROWS,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """``facts.join(side, key, how)`` for an inner, left, left_semi or left_anti join.

    ``spread_by`` names the columns that tell facts of one key apart (all that can be hashed, when None).
    Facts that are equal in them meet the same copy.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"facts cannot be dealt in a join of kind {how!r}")
    heavy = heavy_keys(facts, key, heavy_rows)
    by = spread_by or [f.name for f in facts.schema if "map<" not in f.dataType.simpleString()]
    known = heavy.withColumnRenamed(key, "_heavy")
    marked = facts.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_heavy")), "left")  # MOST_HEAVY rows at most
    spread = F.coalesce(F.pmod(F.xxhash64(*by), F.col(_COPIES)), F.lit(0)).cast("int")
    dealt = marked.withColumn(_COPY, spread).drop("_heavy", _COPIES)
    copied = _copies(side.join(F.broadcast(heavy), key, "left"))
    return dealt.join(copied, [key, _COPY], how).drop(_COPY)


def _copies(side: DataFrame) -> DataFrame:
    last: Column = F.coalesce(F.col(_COPIES), F.lit(1)) - 1
    return side.withColumn(_COPY, F.explode(F.sequence(F.lit(0), last))).drop(_COPIES)
