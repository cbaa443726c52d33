import datetime as dt

import pytest
from calendar_days import day

from userbaseline.operators import features as f

T = dt.datetime


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [
        # id, user, start, last command, stamp
        (1, 1, T(2024, 1, 1, 9, 5, 7), T(2024, 1, 1, 9, 6, 7), "2024010109"),
        (2, 1, T(2024, 1, 1, 20, 0, 0), T(2024, 1, 1, 19, 59, 50), "2024010120"),
        (3, 1, T(2024, 1, 2, 8, 0, 0), None, "2024010208"),
        (4, 2, T(2024, 1, 2, 8, 0, 30), T(2024, 1, 2, 8, 0, 30), "2024010208"),
        (5, None, T(2024, 1, 2, 8, 0, 0), T(2024, 1, 2, 8, 1, 0), "2024010208"),
    ]
    df = spark.createDataFrame(
        rows, "session_id long, user_id long, start_ts timestamp_ntz, last_ts timestamp_ntz, stamp string"
    )
    return df.selectExpr("*", "to_date(start_ts) as day")


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        (1, 1, "ls", "GOOD"), (2, 1, "rm", "BAD"), (3, 1, None, "GOOD"),
        (4, 3, "cd", "GOOD"), (5, 4, "rm", "BAD"), (6, 4, "rm", "BAD"),
    ]
    return spark.createDataFrame(rows, "cmd_id long, session_id long, cmd string, cmd_rep string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_users(sessions):
    assert f.user_count(sessions).first().users == 2
    assert f.user_count(sessions, approximate=True).first().users == 2
    assert f.distinct_users(sessions).count() == 3
    assert f.observed_days(sessions).count() == 4


def test_sessions_per_day_counts_each_session_once(sessions):
    twice = sessions.union(sessions)
    got = f.sessions_per_day(twice.filter("user_id = 1"))
    assert rows(got, "day", "sessions_per_day") == [(day(1), 2), (day(2), 1)]


def test_commands_null_ones_do_not_count(labelled):
    assert rows(f.commands_per_session(labelled), "session_id", "cmds") == [(1, 2), (3, 1), (4, 2)]


def test_sessions_without_commands_are_left_out_of_the_mean(sessions, labelled):
    got = f.mean_commands_per_day(sessions, labelled)
    assert rows(got, "user_id", "day", "cmd_per_day") == [
        (1, day(1), 2.0), (1, day(2), 1.0), (2, day(2), 2.0),
    ]


def test_duration_is_signed_and_null_propagates(sessions):
    got = {r.session_id: r.seconds for r in f.session_duration(sessions).collect()}
    assert got == {1: 60, 2: -10, 3: None, 4: 0, 5: 60}


def test_mean_duration_drops_days_without_one(sessions):
    got = f.mean_duration_per_day(sessions.filter("user_id = 1"))
    assert rows(got, "day", "sess_dur") == [(day(1), 25.0)]


def test_reputation(sessions, labelled):
    got = f.reputation_per_session(labelled)
    assert rows(got, "session_id", "good", "bad", "total") == [(1, 2, 1, 3), (3, 1, 0, 1), (4, 0, 2, 2)]
    shares = f.reputation_share_per_day(sessions, labelled)
    assert rows(shares, "user_id", "good_cmd", "bad_cmd") == [(1, 2 / 3, 1 / 3), (1, 1.0, 0.0), (2, 0.0, 1.0)]


def test_daily_features_equal_the_single_ones(sessions, labelled):
    sessions = sessions.filter("user_id is not null")
    day_key = ["user_id", "day"]
    parts = f.sessions_per_day(sessions)
    for other in (
        f.mean_commands_per_day(sessions, labelled),
        f.mean_duration_per_day(sessions),
        f.reputation_share_per_day(sessions, labelled),
    ):
        parts = parts.join(other, day_key, "left")
    names = [*day_key, "sessions_per_day", "cmd_per_day", "sess_dur", "good_cmd", "bad_cmd"]
    assert rows(f.daily_features(sessions, labelled), *names) == rows(parts, *names)


def test_first_session_and_latest_days(sessions):
    first = f.first_sessions(sessions.filter("user_id = 1"))
    assert rows(first, "day", "session_id") == [(day(1), 1), (day(2), 3)]
    latest = f.latest_days(f.sessions_per_day(sessions.filter("user_id = 1")), 1)
    assert rows(latest, "day") == [(day(2),)]


def test_origin(spark):
    a = spark.createDataFrame([("x",)], "cmd string")
    assert rows(f.with_origin(a, a), "cmd", "origin") == [("x", "test"), ("x", "train")]
