"""Sessions and commands derived from a flat event log.

Events of one user belong to one session until a gap of ``SESSION_GAP_HOURS`` or more. The log
is first reduced to one row per user and clock interval no longer than the gap: two events in
one interval can never be split, so session borders follow from the reduced rows alone. A user
with any number of events thus needs a few rows per day in the window, never all events.

Events without a user keep their rows: they form sessions and commands of the user NULL. What is
joined by user (features of a day, flags) leaves NULL users out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSION_GAP_HOURS = 6


def _interval_hours(gap_hours: int) -> int:
    return max(h for h in (1, 2, 3, 4, 6, 8, 12, 24) if h <= gap_hours)


def _slot(ts: Column, hours: int) -> Column:
    """The clock interval of a time, named by its first hour since the epoch."""
    return F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts) - F.hour(ts) % hours


def session_slots(events: DataFrame, gap_hours: int = SESSION_GAP_HOURS) -> DataFrame:
    """One row per (user, clock interval with events), numbered by the session it belongs to.

    All aggregates are of fixed width, so the map tasks combine by hashing without a sort.
    """
    reduced = events.groupBy(
        "user_id", _slot(F.col("ts"), _interval_hours(gap_hours)).alias("slot")
    ).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("event_id").alias("first_id"),
        F.count(F.lit(1)).alias("n_commands"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.count_if(F.col("event_type") == "signup").alias("n_signups"),
    )
    w = W.partitionBy("user_id").orderBy("slot")
    gap = F.make_dt_interval(hours=F.lit(gap_hours))
    opens = F.coalesce(F.col("first_ts") >= F.lag("last_ts").over(w) + gap, F.lit(True))
    return reduced.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn(
        "session_no", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0))
    )


def sessions(events: DataFrame, gap_hours: int = SESSION_GAP_HOURS) -> DataFrame:
    """One row per session, with the columns the session queries need.

    A session's id is the smallest id of its events. The ``_ref`` columns are dictionary ids.
    """
    merged = (
        session_slots(events, gap_hours)
        .groupBy("user_id", "session_no")
        .agg(
            F.min("first_id").alias("session_id"),
            F.min("first_ts").alias("start_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n_commands").alias("commands_count"),
            F.sum("n_errors").alias("violations"),
            (F.sum("n_errors") + F.sum("n_signups")).alias("triggered_total"),
        )
    )
    start, failed = F.col("start_ts"), F.col("violations") > 0
    return merged.select(
        "session_id",
        "user_id",
        "start_ts",
        "last_ts",
        F.to_date(start).alias("day"),
        F.date_format(start, "yyyyMMddHH").alias("stamp"),
        (F.col("session_id") % 10).alias("server_id"),
        (F.col("session_id") % 30).alias("ip_id"),
        "commands_count",
        "violations",
        "triggered_total",
        dictionary_id(F.when(failed, "error").otherwise("view")).alias("user_ref"),
        dictionary_id(F.when(F.col("commands_count") > 1, "click")).alias("ports_ref"),
        dictionary_id(F.when(failed, "nobody").otherwise("purchase")).alias("created_by_ref"),
        dictionary_id(F.concat_ws(" ", F.lit("signup"), _props(F.col("commands_count")))).alias("ip_ref"),
    )


def _props(k: Column) -> Column:
    return F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))


def commands(events: DataFrame, gap_hours: int = SESSION_GAP_HOURS) -> DataFrame:
    """One row per event, seen as a command typed in its session; ``day`` is the session's day."""
    of_session = W.partitionBy("user_id", "session_no")
    slots = session_slots(events, gap_hours).select(
        "user_id",
        "slot",
        F.min("first_id").over(of_session).alias("session_id"),
        F.to_date(F.min("first_ts").over(of_session)).alias("day"),
    )
    typed = events.withColumn("slot", _slot(F.col("ts"), _interval_hours(gap_hours))).alias("e")
    # events without a user form sessions too, so they have to find theirs
    same = F.col("e.user_id").eqNullSafe(F.col("s.user_id")) & (F.col("e.slot") == F.col("s.slot"))
    return (
        typed.join(slots.alias("s"), same)
        .select(
            F.col("event_id").alias("cmd_id"),
            "session_id",
            "e.user_id",
            "ts",
            "day",
            command_text(F.col("event_type"), F.col("props")).alias("cmd"),
            F.col("event_type").alias("cmd_root"),
            F.col("props").alias("parameters"),
        )
    )


def command_text(event_type: Column, props: Column) -> Column:
    return F.concat_ws(" ", event_type, props)


def rule_label(cmd_root: Column) -> Column:
    """The label a command gets without a model: errors are BAD."""
    return F.when(cmd_root == "error", "BAD").otherwise("GOOD")


def dictionary_id(value: Column) -> Column:
    """An id that depends on the value alone, so no global numbering is needed: its whole digest,
    since shorter ones meet by chance among 10⁹ values of a project."""
    return F.md5(value)
