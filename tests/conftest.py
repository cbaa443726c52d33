import datetime as dt
import os
import sys

import pytest
from calendar_days import day

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from userbaseline.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """A feature table from {user: {day number: value}}."""

    def make(users, feature="sessions_per_day"):
        rows = [(u, day(n), v) for u, days in users.items() for n, v in days.items()]
        return spark.createDataFrame(rows, f"user_id long, day date, {feature} double")

    return make


@pytest.fixture(scope="session")
def command_rows(spark):
    """Commands from (user, day number, session, second of the day, text) tuples."""

    def make(rows):
        full = []
        for i, (user, n, session, second, text) in enumerate(rows):
            ts = dt.datetime.combine(day(n), dt.time()) + dt.timedelta(seconds=second)
            full.append((i, session, user, ts, day(n), text))
        return spark.createDataFrame(
            full, "cmd_id long, session_id long, user_id long, ts timestamp_ntz, day date, cmd string"
        )

    return make
