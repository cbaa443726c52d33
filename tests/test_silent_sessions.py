"""Days with a session but no command, users without an id, other time zones, large counts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from userbaseline.functions import scalars
from userbaseline.models import text_features as tf
from userbaseline.operators import enrich
from userbaseline.plans import behaviour, catalog
from userbaseline.sources import event_log, readers
from userbaseline.streaming import sessions as streaming

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("feature", ["cmd_per_day", "bad_cmd"])
def test_single_flag_is_the_matrix_column(spark, feature):
    queries = catalog.queries()
    single = {"cmd_per_day": "flag_commands_silent_sessions", "bad_cmd": "flag_bad_silent_sessions"}[feature]
    flags = {(r.user_id, r.day): r.flag for r in queries[single](spark, FOLDER).collect()}
    rows = queries["flag_matrix_silent_sessions"](spark, FOLDER).collect()
    assert flags == {(r.user_id, r.day): r[feature] for r in rows}
    silent = [r for r in queries[single](spark, FOLDER).collect() if r.feature_value is None]
    assert silent and all(r.flag == 0 and not r.baseline_ok for r in silent)


def test_start_in_a_gap_of_the_zone(new_york):
    """02:30 does not exist on that night in New York; the clock reading stays as it is."""
    at = dt.datetime(2024, 3, 10, 2, 30, 5, 500_000)
    df = new_york.createDataFrame(
        [("2024031002", at, dt.datetime(2024, 3, 10, 3, 30, 5)), ("2024031099", at, at), ("x", at, at), (None, at, at), ("2024031002", None, at)],
        "stamp string, t timestamp_ntz, e timestamp_ntz",
    )
    start = scalars.session_start(F.col("stamp"), F.col("t"))
    minute = scalars.session_start_minute(F.col("stamp"), F.col("t"))
    got = df.select(
        start.cast("string").alias("s"), minute.cast("string").alias("m"),
        scalars.seconds_between(start, F.col("e")).alias("d"), scalars.seconds_between(F.col("e"), start).alias("back"),
    ).collect()
    assert tuple(got[0]) == ("2024-03-10 02:30:05", "2024-03-10 02:30:00", 3600, -3600)
    assert all(tuple(r) == (None, None, None, None) for r in got[1:])


def test_instants_do_not_depend_on_the_zone(new_york):
    at = dt.datetime(2024, 3, 10, 2, 30, 5, 123_456)
    df = new_york.createDataFrame([(at,), (dt.datetime(1969, 12, 31, 23, 59, 59, 1),)], "t timestamp_ntz")
    there = scalars.as_instant(F.col("t"))
    got = df.select(F.unix_micros(there).alias("u"), scalars.as_clock(there).cast("string").alias("back"), F.col("t").cast("string").alias("t")).collect()
    assert got[0].u == 1_710_037_805_123_456
    assert all(r.back == r.t for r in got)


def test_streamed_sessions_in_another_zone_with_a_hot_user(new_york, tmp_path):
    start = dt.datetime(2024, 3, 10, 0, 0)
    rows = [(i, start + dt.timedelta(minutes=i), 1) for i in range(600)]  # one user has nearly all events
    rows += [(1000, start, 2), (1001, start + dt.timedelta(hours=6), 2), (1002, start + dt.timedelta(days=9), 3)]
    events = new_york.createDataFrame(
        [(i, t, u, "view", 0.0, "{}") for i, t, u in rows],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    )
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    stream = streaming.event_stream(new_york, str(tmp_path / "events.parquet"), "*.parquet")
    out = streaming.run_available(streaming.closed_sessions(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.user_id, str(r.start_ts), str(r.last_ts), r.n_commands) for r in out.collect())
    assert got == [
        (1, "2024-03-10 00:00:00", "2024-03-10 09:59:00", 600),
        (2, "2024-03-10 00:00:00", "2024-03-10 00:00:00", 1),
        (2, "2024-03-10 06:00:00", "2024-03-10 06:00:00", 1),
    ]
    assert new_york.conf.get(streaming.MERGE_FIRST) == "false"


def test_events_without_a_user(spark):
    at = dt.datetime(2024, 1, 1, 9)
    rows = [(1, at, None), (2, at + dt.timedelta(hours=1), None), (3, at, 7), (4, at + dt.timedelta(hours=9), None)]
    events = spark.createDataFrame(
        [(i, t, u, "view", 0.0, "{}") for i, t, u in rows],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    )
    sessions = {(r.session_id, r.user_id, r.commands_count) for r in event_log.sessions(events).collect()}
    assert sessions == {(1, None, 2), (3, 7, 1), (4, None, 1)}
    commands = {(r.cmd_id, r.session_id, r.user_id) for r in event_log.commands(events).collect()}
    assert commands == {(1, 1, None), (2, 1, None), (3, 3, 7), (4, 4, None)}


def test_moments_of_large_counts(spark, monkeypatch):
    """A term seen 5·10⁹ times, in two of three texts."""
    counts = spark.createDataFrame([(1, "a", 5 * 10**9), (2, "a", 5 * 10**9 + 3)], "doc_id long, term string, n long")
    monkeypatch.setattr(tf, "term_counts", lambda corpus, key="doc_id": counts)
    row = tf.term_moments(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")).first()
    values = [5e9, 5e9 + 3, 0.0]
    mean = sum(values) / 3
    assert row["mean"] == pytest.approx(mean)
    assert row.sd == pytest.approx((sum((v - mean) ** 2 for v in values) / 2) ** 0.5)


def test_unpivot_of_a_hot_project(spark):
    """Nine tenths of the facts in one project, a dictionary beyond any broadcast, no sort in the plan."""
    facts = spark.range(2000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).cast("long").alias("project_id"),
        *[F.md5((F.col("id") % n).cast("string")).alias(ref) for n, ref in zip((3, 5, 7, 11, 13, 17), enrich.SESSION_ROLES.values())],
    )
    dictionary = spark.range(17).join(spark.range(2000).select(F.col("id").alias("project_id"))).select(
        "project_id", F.md5(F.col("id").cast("string")).alias("id"), F.when(F.col("id") != 4, F.concat(F.lit("v"), "id")).alias("value")
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unpivoted = enrich.with_roles_unpivoted(facts, "k", dictionary, enrich.SESSION_ROLES, enrich.SESSION_BLANKS)
        joined = enrich.with_roles(facts, dictionary, enrich.SESSION_ROLES, enrich.SESSION_BLANKS)
        plan = unpivoted._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
        columns = unpivoted.columns
        assert sorted(map(str, unpivoted.collect())) == sorted(map(str, joined.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_tenant_read_is_pruned(spark):
    plan = catalog.queries()["tenant_partition_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_pipeline_stops_without_sessions(spark):
    sessions = spark.createDataFrame([], "session_id long, server_id long, stamp string, start_ts timestamp_ntz")
    servers = spark.createDataFrame([(1, 1)], "server_id long, project_id long")
    projects = spark.createDataFrame([(1, 1)], "project_id long, company_id long")
    periods = spark.createDataFrame([], "project_id long, start_date timestamp_ntz, end_date timestamp_ntz")
    with pytest.raises(ValueError, match="no rows"):
        behaviour.opted_in(sessions, sessions, servers, projects, periods, "2024-02-01")
    assert readers.require_rows(servers, "servers") is servers
