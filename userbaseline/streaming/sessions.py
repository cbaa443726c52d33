"""Sessions counted as the event log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from userbaseline.functions import scalars
from userbaseline.session import scratch_path
from userbaseline.sources.event_log import SESSION_GAP_HOURS

EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)
LATENESS = "1 day"
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """Events from the parquet files of a folder that more files may join."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)


def closed_sessions(
    events: DataFrame, gap_hours: int = SESSION_GAP_HOURS, lateness: str = LATENESS
) -> DataFrame:
    """Sessions that no event within the allowed lateness can extend any more.

    A session window also takes an event exactly one gap after the last, which by the rule of the
    batch form begins a new session; hence the gap is one microsecond shorter here.
    """
    gap = f"{gap_hours * 3600 - 1} seconds 999999 microseconds"
    return (
        events.select("user_id", scalars.as_instant(F.col("ts")).alias("at"))
        .withWatermark("at", lateness)
        .groupBy("user_id", F.session_window("at", gap).alias("w"))
        .agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_commands"))
        .select(
            "user_id",
            scalars.as_clock(F.col("w.start")).alias("start_ts"),
            scalars.as_clock(F.col("last_at")).alias("last_ts"),
            "n_commands",
        )
    )


def run_available(sessions: DataFrame, out: str, state: str) -> DataFrame:
    """Process what is there, append closed sessions to ``out`` and read them back.

    Sessions are merged inside the map tasks first, so a user with most of the events sends a few
    rows per task; the setting is put back once the query holds it.
    """
    spark = sessions.sparkSession
    merging = spark.conf.get(MERGE_FIRST)
    spark.conf.set(MERGE_FIRST, "true")
    writer = sessions.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    try:
        query = writer.option("path", out).option("checkpointLocation", state).start()
    finally:
        spark.conf.set(MERGE_FIRST, merging)
    query.awaitTermination()
    return spark.read.schema(sessions.schema).parquet(out)


def sessions_per_day(
    spark: SparkSession, folder: str, gap_hours: int = SESSION_GAP_HOURS, lateness: str = LATENESS
) -> DataFrame:
    """Closed sessions per user and day, from one run over the files in ``folder``."""
    base = scratch_path(spark, "stream-sessions")
    closed = run_available(
        closed_sessions(event_stream(spark, folder), gap_hours, lateness), f"{base}/out", f"{base}/state"
    )
    return closed.groupBy("user_id", F.to_date("start_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("sessions_per_day")
    )
