"""Deliveries day by day against the flags of the whole log."""

import datetime as dt
import random

import pytest
from calendar_days import day

from userbaseline.plans import behaviour, daily
from userbaseline.session import scratch_path

SESSION = "session_id long, user_id long, start_ts timestamp_ntz, last_ts timestamp_ntz, day date, stamp string"
COMMAND = "cmd_id long, session_id long, user_id long, ts timestamp_ntz, day date, cmd string, cmd_rep string"
WORDS = ["ls", "cd /tmp", "cat notes", "rm -r x", "top"]


def log(seed, users=(1, 2, None), days=75, busy=0.4):
    rng = random.Random(seed)
    sessions, commands = [], []
    for user in users:
        for n in range(1, days + 1):
            if user == 2 and 15 < n < 62 or rng.random() > busy:
                continue
            for k in range(rng.choice([1, 1, 2, 4])):
                number = len(sessions)
                start = dt.datetime.combine(day(n), dt.time(hour=2 + k))
                typed = rng.choice([0, 1, 2, 5])
                last = start + dt.timedelta(seconds=rng.randint(1, 900))
                sessions.append((number, user, start, last, day(n), start.strftime("%Y%m%d%H")))
                for c in range(typed):
                    text = rng.choice([*WORDS, None])
                    rep = rng.choice(["GOOD", "GOOD", "BAD"])
                    commands.append((len(commands), number, user, start + dt.timedelta(seconds=c), day(n), text, rep))
    return sessions, commands


def frames(spark, sessions, commands):
    return spark.createDataFrame(sessions, SESSION), spark.createDataFrame(commands, COMMAND)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def whole(spark, sessions, commands, **options):
    flags = behaviour.flag_matrix(*frames(spark, sessions, commands), **options)
    return rows(flags)


def without(log_, dropped):
    sessions, commands = log_
    return [s for s in sessions if not dropped(s[0], s[4])], [c for c in commands if not dropped(c[1], c[4])]


@pytest.mark.parametrize("seed, week_mode", [(1, "mean"), (2, "last")])
def test_single_days_equal_the_whole_log(spark, seed, week_mode):
    known = log(seed)
    s, c = frames(spark, *known)
    path = scratch_path(spark, "daily")
    daily.advance(spark, path, 0, s, c, day(1), day(68), week_mode=week_mode)
    for step, n in enumerate((69, 70, 71), 1):
        daily.advance(spark, path, step, s, c, day(n), day(n), week_mode=week_mode)
    daily.advance(spark, path, 4, s, c, day(72), day(75), week_mode=week_mode)
    assert rows(daily.current(spark, path)) == whole(spark, *known, week_mode=week_mode)


def test_late_repeated_and_withdrawn_days(spark):
    known = log(3, busy=0.7)
    # day 71 comes late, day 72 first without its odd sessions, day 73 first with sessions that are taken back
    first = without(known, lambda number, d: d == day(71) or d == day(72) and number % 2)
    last = without(known, lambda number, d: d == day(73) and number % 2)
    path = scratch_path(spark, "daily")
    deliveries = [(first, 1, 70), (first, 72, 72), (first, 73, 73), (known, 71, 71), (known, 72, 72), (last, 73, 73), (last, 74, 75)]
    for step, (given, low, high) in enumerate(deliveries):
        daily.advance(spark, path, step, *frames(spark, *given), day(low), day(high), lateness=4)
    assert rows(daily.current(spark, path)) == whole(spark, *last)


def test_days_beyond_the_lateness_are_refused(spark):
    s, c = frames(spark, *log(4, users=(1,), days=9))
    path = scratch_path(spark, "daily")
    daily.advance(spark, path, 0, s, c, day(1), day(6), lateness=2)
    with pytest.raises(ValueError, match="more than 2 days"):
        daily.advance(spark, path, 1, s, c, day(3), day(3), lateness=2)
    with pytest.raises(ValueError, match="reaches back"):
        daily.advance(spark, path, 1, s, c, day(7), day(7), lateness=5)


def test_a_step_run_again_gives_the_same(spark):
    known = log(5, users=(1, 2), days=12)
    s, c = frames(spark, *known)
    path = scratch_path(spark, "daily")
    daily.advance(spark, path, 0, s, c, day(1), day(11))
    for _ in range(2):
        daily.advance(spark, path, 1, s, c, day(12), day(12))
    assert rows(daily.current(spark, path)) == whole(spark, *known)


def test_empty_deliveries(spark):
    s, c = frames(spark, [], [])
    path = scratch_path(spark, "daily")
    daily.advance(spark, path, 0, s, c, day(1), day(1))
    daily.advance(spark, path, 1, s, c, day(2), day(2))
    assert rows(daily.current(spark, path)) == []
    known = log(6, users=(1,), days=5)
    daily.advance(spark, path, 2, *frames(spark, *known), day(3), day(5))
    late = without(known, lambda _, d: d < day(3))
    assert rows(daily.current(spark, path)) == whole(spark, *late)


def test_a_step_reads_the_delivered_day_only(spark, tmp_path):
    """The other days of the log are files that nobody can read."""
    known = log(7, users=(1, 2), days=20, busy=0.9)
    s, c = frames(spark, *known)
    path, parts = scratch_path(spark, "daily"), {}
    daily.advance(spark, path, 0, s, c, day(1), day(19))
    for name, table in (("sessions", s), ("commands", c)):
        table.filter(table.day == day(20)).write.partitionBy("day").parquet(str(tmp_path / name))
        for n in range(1, 20):
            folder = tmp_path / name / f"day={day(n)}"
            folder.mkdir()
            (folder / "part.parquet").write_text("no table")
        parts[name] = spark.read.schema(table.schema).parquet(str(tmp_path / name))
    daily.advance(spark, path, 1, parts["sessions"], parts["commands"], day(20), day(20))
    assert rows(daily.current(spark, path)) == whole(spark, *known)
