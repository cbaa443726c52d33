"""Daily features per user.

Every aggregation combines inside the map tasks before it shuffles, so a user or a session
with a large share of all rows reaches the reducer as a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from userbaseline.functions import scalars


def user_count(sessions: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct users; sessions without a user do not count."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return sessions.agg(count("user_id").alias("users"))


def distinct_users(sessions: DataFrame) -> DataFrame:
    return sessions.select("user_id").distinct()


def distinct_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id").distinct()


def observed_days(sessions: DataFrame) -> DataFrame:
    return sessions.select("user_id", "day").distinct()


def observed_day_count(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count_distinct("day").alias("days"))


#: log2 of a sketch's registers: standard error 1.04 / √2¹⁴ = 0.8 percent
SKETCH_BITS = 14


def user_sketches(sessions: DataFrame) -> DataFrame:
    """(day, users): a mergeable sketch of each day's distinct users, for counts over any span of days
    without reading the sessions again. Sessions without a user do not count."""
    users = F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS))
    return sessions.filter(F.col("user_id").isNotNull()).groupBy("day").agg(users.alias("users"))


def users_of_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, estimate): about how many distinct users the days of each group have together."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("users"))
    return sketches.groupBy(*keys).agg(merged.alias("estimate"))


def sessions_per_day(sessions: DataFrame) -> DataFrame:
    """Feature 1. Days without a session have no row."""
    return sessions.groupBy("user_id", "day").agg(
        F.count_distinct("session_id").alias("sessions_per_day")
    )


def commands_per_session(commands: DataFrame) -> DataFrame:
    """Non-null commands of each session."""
    return commands.groupBy("session_id").agg(F.count(F.lower("cmd")).alias("cmds"))


def commands_per_session_day(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """The count next to the session's day; sessions without commands are left out."""
    return sessions.select("user_id", "day", "session_id").join(
        commands_per_session(commands), "session_id"
    )


def mean_commands_per_day(sessions: DataFrame, commands: DataFrame) -> DataFrame:
    """Feature 2: mean commands per session."""
    return (
        commands_per_session_day(sessions, commands)
        .groupBy("user_id", "day")
        .agg(F.avg("cmds").alias("cmd_per_day"))
    )


def session_duration(sessions: DataFrame) -> DataFrame:
    """Seconds from the session's start to its last command."""
    start = scalars.session_start(F.col("stamp"), F.col("start_ts"))
    return sessions.select(
        "session_id", scalars.seconds_between(start, F.col("last_ts")).alias("seconds")
    )


def session_duration_by_day(sessions: DataFrame) -> DataFrame:
    days = sessions.select("session_id", "user_id", "day")
    return days.join(session_duration(sessions), "session_id")


def mean_duration_per_day(sessions: DataFrame) -> DataFrame:
    """Feature 3: mean session duration; a day whose durations are all unknown has no row."""
    start = scalars.session_start(F.col("stamp"), F.col("start_ts"))
    return (
        sessions.select(
            "user_id", "day", scalars.seconds_between(start, F.col("last_ts")).alias("seconds")
        )
        .filter(F.col("seconds").isNotNull())
        .groupBy("user_id", "day")
        .agg(F.avg("seconds").alias("sess_dur"))
    )


def _labelled(label: str) -> Column:
    return F.count_if(F.col("cmd_rep") == label)


def reputation_per_session(labelled: DataFrame) -> DataFrame:
    """GOOD, BAD and all commands of each session; needs (session_id, cmd_rep)."""
    return labelled.groupBy("session_id").agg(
        _labelled("GOOD").alias("good"), _labelled("BAD").alias("bad"), F.count(F.lit(1)).alias("total")
    )


def reputation_means_per_day(sessions: DataFrame, labelled: DataFrame) -> DataFrame:
    return (
        sessions.select("user_id", "day", "session_id")
        .join(reputation_per_session(labelled), "session_id")
        .groupBy("user_id", "day")
        .agg(
            F.avg("total").alias("mean_total"),
            F.avg("good").alias("mean_good"),
            F.avg("bad").alias("mean_bad"),
        )
    )


def reputation_share_per_day(sessions: DataFrame, labelled: DataFrame) -> DataFrame:
    """Features 4 and 5: the mean of GOOD, and of BAD, over the mean of all."""
    return reputation_means_per_day(sessions, labelled).select(
        "user_id",
        "day",
        F.try_divide("mean_good", "mean_total").alias("good_cmd"),
        F.try_divide("mean_bad", "mean_total").alias("bad_cmd"),
    )


def first_sessions(sessions: DataFrame) -> DataFrame:
    """Each user's first session of each day."""
    return (
        sessions.groupBy("user_id", "day")
        .agg(F.min(F.struct("start_ts", "session_id")).alias("first"))
        .select("user_id", "day", F.col("first.session_id").alias("session_id"))
    )


def daily_features(sessions: DataFrame, labelled_commands: DataFrame) -> DataFrame:
    """Features 1 to 5 in one pass: commands shrink to one row per session, sessions to one per day.

    ``sessions`` has one row per session (see ``enrich.in_opt_in``), ``labelled_commands`` has
    (session_id, cmd, cmd_rep). A feature without data on a day is NULL there.
    """
    per_session = labelled_commands.groupBy("session_id").agg(
        F.count("cmd").alias("cmds"),
        _labelled("GOOD").alias("good"),
        _labelled("BAD").alias("bad"),
        F.count(F.lit(1)).alias("total"),
    )
    start = scalars.session_start(F.col("stamp"), F.col("start_ts"))
    return (
        sessions.select(
            "session_id",
            "user_id",
            "day",
            scalars.seconds_between(start, F.col("last_ts")).alias("seconds"),
        )
        .join(per_session, "session_id", "left")
        .groupBy("user_id", "day")
        .agg(
            F.count("session_id").alias("sessions_per_day"),
            F.avg("cmds").alias("cmd_per_day"),
            F.avg("seconds").alias("sess_dur"),
            F.try_divide(F.avg("good"), F.avg("total")).alias("good_cmd"),
            F.try_divide(F.avg("bad"), F.avg("total")).alias("bad_cmd"),
        )
    )


def latest_days(series: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` days of each user, oldest first."""
    w = W.partitionBy("user_id").orderBy(F.desc("day"))
    return (
        series.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")
    )


def with_origin(training: DataFrame, test: DataFrame) -> DataFrame:
    """Training and test rows in one table, told apart by ``origin``."""
    return training.withColumn("origin", F.lit("train")).unionByName(
        test.withColumn("origin", F.lit("test"))
    )
