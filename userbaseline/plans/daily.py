"""Flags kept up to date: each delivery of whole days is met with a stored state, not with the history.

The state after a step holds, for every user, the days that may still be delivered again (those from
``lateness`` days before the latest one on), the ``KEPT_DAYS`` observed days before them, and the commands
of the former and of the one day with commands before them. That is all that baselines and
similarity of those days can look at, so flags equal those computed over the whole log. A step reads
the delivered days of the log and the state before it; only users of the delivered days are computed anew,
from the first delivered day on.

Folders below ``path``: ``state/step=<n>`` and ``changes/step=<n>``. A step reads the state of the step before
and overwrites its own folders, so one that was lost half-way is simply run again. Older states may be removed.

A delivery replaces what was known of its days. Rows without a day belong to no delivery; rows without a
user form the user NULL, who has no similarity. A delivery without rows only moves the latest day on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from userbaseline.operators import features, rules, similarity
from userbaseline.operators.baselines import MONTH_DAYS
from userbaseline.session import cut

DAY = ["user_id", "day"]
#: the days of a month's look-back, and the one before them
KEPT_DAYS = MONTH_DAYS + 1
_TYPED = [*DAY, "ts", "cmd_id", "cmd"]


def advance(
    spark: SparkSession,
    path: str,
    step: int,
    sessions: DataFrame,
    labelled_commands: DataFrame,
    since: dt.date,
    until: dt.date,
    lateness: int = 0,
    week_mode: str = "mean",
) -> DataFrame:
    """Put the days ``since`` … ``until`` of a log onto the state of ``step - 1`` (none for step 0).

    Gives the changes, as written: (user_id, day), six flags, ``baseline_ok`` and ``observed``, which is false for
    days that the delivery took back. A log partitioned by ``day`` is read for these days only. Raises when
    ``since`` is more than ``lateness`` days before the latest day delivered.
    """
    low = F.lit(since).cast("date")
    delivered = F.col("day").between(low, F.lit(until).cast("date"))
    typed = labelled_commands.filter(delivered)
    new = cut(_doubles(features.daily_features(sessions.filter(delivered), typed)))
    texts = typed.filter(F.col("cmd").isNotNull() & F.col("user_id").isNotNull()).select(*_TYPED)
    latest = until
    if step == 0:
        series = new.withColumn("five_cmd_match", F.lit(None).cast("double")).filter(F.lit(False))
        held = texts.filter(F.lit(False))
    else:
        before = f"{path}/state/step={step - 1}"
        series, held = spark.read.parquet(f"{before}/series"), spark.read.parquet(f"{before}/commands")
        known = spark.read.parquet(f"{before}/latest").first()
        if since < known.latest - dt.timedelta(days=known.lateness):
            raise ValueError(f"{since} is more than {known.lateness} days before {known.latest}")
        latest = max(until, known.latest)
        if lateness > known.lateness + (latest - known.latest).days:
            raise ValueError(f"the state reaches back {known.lateness} days before {known.latest} only")

    commands = held.filter(~delivered).unionByName(texts)
    users = [t.select("user_id") for t in (new, texts, series.filter(delivered), held.filter(delivered))]
    touched = cut(users[0].union(users[1]).union(users[2]).union(users[3]).distinct())
    alike = _similarity(_of(commands, touched), low).withColumnRenamed("five_cmd_match", "alike")
    rows = series.filter(~delivered).unionByName(new, allowMissingColumns=True)
    again = F.col("touched") & (F.col("day") >= low)
    rows = _marked(rows, touched).join(alike, DAY, "left")
    rows = cut(rows.withColumn("five_cmd_match", F.when(again, F.col("alike")).otherwise(F.col("five_cmd_match"))).drop("alike"))

    flags = rules.flags(rows.filter("touched"), week_mode=week_mode).filter(F.col("day") >= low)
    gone = _without(series.filter(delivered).select(*DAY), new)
    changes = flags.withColumn("observed", F.lit(True)).unionByName(
        gone.withColumn("observed", F.lit(False)), allowMissingColumns=True
    )
    changes.write.mode("overwrite").parquet(f"{path}/changes/step={step}")

    floor = F.lit(latest - dt.timedelta(days=lateness)).cast("date")
    rows, after = rows.drop("touched"), f"{path}/state/step={step}"
    open_, closed = F.col("day") >= floor, F.col("day") < floor
    kept = rows.filter(open_).unionByName(features.latest_days(rows.filter(closed), KEPT_DAYS))
    kept.write.mode("overwrite").parquet(f"{after}/series")
    _from(commands, floor).write.mode("overwrite").parquet(f"{after}/commands")
    facts = spark.range(1).select(F.lit(latest).alias("latest"), F.lit(lateness).alias("lateness"))
    facts.write.mode("overwrite").parquet(f"{after}/latest")
    return spark.read.schema(changes.schema).parquet(f"{path}/changes/step={step}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The flag matrix as of the latest step: the newest row of every user and day."""
    changes = spark.read.parquet(f"{path}/changes")
    last = F.max_by(F.struct("observed", *rules.FLAGS, "baseline_ok"), "step").alias("last")
    newest = changes.groupBy(*DAY).agg(last).filter("last.observed")
    return newest.select(*DAY, *[F.col(f"last.{c}").alias(c) for c in (*rules.FLAGS, "baseline_ok")])


def _doubles(daily: DataFrame) -> DataFrame:
    return daily.select(*DAY, *[F.col(c).cast("double").alias(c) for c in daily.columns if c not in DAY])


def _same_user(left: str, right: str):
    return F.col(f"{left}.user_id").eqNullSafe(F.col(f"{right}.user_id"))


def _of(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.alias("r").join(users.alias("u"), _same_user("r", "u"), "left_semi")


def _marked(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with ``touched``, whether their user is one of ``users``."""
    known = users.withColumn("known", F.lit(True))
    met = rows.alias("r").join(known.alias("u"), _same_user("r", "u"), "left")
    return met.select("r.*", F.coalesce("known", F.lit(False)).alias("touched"))


def _without(days: DataFrame, others: DataFrame) -> DataFrame:
    same = _same_user("d", "o") & (F.col("d.day") == F.col("o.day"))
    return days.alias("d").join(others.alias("o"), same, "left_anti")


def _from(commands: DataFrame, floor) -> DataFrame:
    """Commands of the days from ``floor`` on, and of each user's last day before it."""
    older = commands.filter(F.col("day") < floor)
    last = older.groupBy("user_id").agg(F.max("day").alias("day"))
    return commands.filter(F.col("day") >= floor).unionByName(older.join(last, DAY, "left_semi"))


def _similarity(commands: DataFrame, low) -> DataFrame:
    return similarity.day_similarity(_from(commands, low)).filter(F.col("day") >= low)
