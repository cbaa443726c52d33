import datetime as dt

import pytest
from calendar_days import START, day
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from userbaseline.operators import baselines as b

DAYS = [1, 2, 3, 5, 8, 9, 15, 16, 30, 31, 45, 46]
VALUES = [2, 4, 6, 1, 3, 5, 8, 7, 2, 9, 4, 6]
FEATURE = "sessions_per_day"


@pytest.fixture(scope="module")
def one_user(series):
    return series({1: dict(zip(DAYS, map(float, VALUES)))})


def by_day(df):
    return {(r.day - START).days + 1: r for r in df.collect()}


def test_anchors_on_paper(one_user):
    got = {n: (r.idx, r.week_idx, r.month_idx) for n, r in by_day(b.anchors(one_user)).items()}
    assert got == {
        1: (1, None, None),
        2: (2, None, None),
        3: (3, 1, None),
        5: (4, 1, None),
        8: (5, 2, 1),
        9: (6, 3, 1),
        15: (7, 5, 1),
        16: (8, 6, 1),
        30: (9, None, None),
        31: (10, 8, 2),
        45: (11, None, None),
        46: (12, 10, 9),
    }


def test_previous_day_is_the_previous_observed_one(one_user):
    got = by_day(b.anchors(one_user))
    assert got[1].prev_day is None
    assert got[30].prev_day == day(16)


def test_means_on_paper(one_user):
    got = by_day(b.with_baselines(one_user, [FEATURE]))
    expected = {8: (1, 11 / 3, 3), 9: (3, 10 / 3, 4), 15: (5, 4, 3.2), 31: (2, 4.5, 34 / 7), 46: (4, 6.5, 5.5)}
    for n, (prev, week, month) in expected.items():
        assert got[n].sessions_per_day_prev == prev
        assert got[n].sessions_per_day_week == pytest.approx(week)
        assert got[n].sessions_per_day_month == pytest.approx(month)
        assert got[n].sessions_per_day_ok
    for n in (1, 2, 3, 30, 45):
        assert not got[n].sessions_per_day_ok


def test_week_as_its_last_value(one_user):
    got = by_day(b.with_baselines(one_user, [FEATURE], week_mode="last"))
    assert got[15].sessions_per_day_week == 5
    assert got[30].sessions_per_day_week is None


def test_month_anchor_later_than_week_anchor(series):
    got = by_day(b.with_baselines(series({1: {1: 10.0, 40: 20.0, 41: 1.0}}), [FEATURE]))
    assert (got[41].week_idx, got[41].month_idx) == (1, 2)
    assert got[41].sessions_per_day_month == 15


def test_a_missing_value_keeps_its_place_but_not_its_weight(series):
    got = by_day(b.with_baselines(series({1: {1: 2.0, 2: 4.0, 3: None, 4: 8.0, 9: 1.0}}), [FEATURE]))
    assert got[9].week_idx == 3
    assert got[9].sessions_per_day_week == 8
    assert not got[3].sessions_per_day_ok


def test_unknown_week_mode(one_user):
    with pytest.raises(ValueError):
        b.with_baselines(one_user, [FEATURE], week_mode="median")


def plain_anchors(days, t):
    """Both anchors of day t by walking the sorted days; None where there is none."""
    at = days.index(t)
    before = [i for i in range(at) if t - 6 <= days[i]]
    if not before:
        return None, None
    week = before[0] - (before[0] == at - 1)
    if week < 0:
        return None, None
    month = next(i for i in range(at) if t - 29 <= days[i])
    month -= month == week
    return week, None if month < 0 else month


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.integers(1, 120), min_size=1, max_size=70), min_size=1, max_size=25))
def test_anchors_and_means_on_random_calendars(series, calendars):
    users = {u: {n: float((n * 7 + u) % 11) for n in sorted(c)} for u, c in enumerate(calendars)}
    for r in b.with_baselines(series(users), [FEATURE]).collect():
        days = sorted(users[r.user_id])
        values = [users[r.user_id][n] for n in days]
        n = (r.day - START).days + 1
        at = days.index(n)
        week, month = plain_anchors(days, n)
        assert r.week_idx == (None if week is None else week + 1)
        assert r.month_idx == (None if month is None else month + 1)
        if week is not None:
            part = values[week:at]
            assert r.sessions_per_day_week == pytest.approx(sum(part) / len(part))
        if month is not None:
            low, high = sorted((week, month))
            part = values[low : high + 1]
            assert r.sessions_per_day_month == pytest.approx(sum(part) / len(part))


def test_frozen_baselines_serve_all_test_days(one_user):
    got = by_day(b.frozen_baselines(one_user, [FEATURE], str(day(10))))
    assert sorted(got) == [15, 16, 30, 31, 45, 46]
    assert {r.sessions_per_day_week for r in got.values()} == {4}
    assert {r.sessions_per_day_month for r in got.values()} == {3.2}


def test_split(one_user):
    got = {n: r.split for n, r in by_day(b.split_by_date(one_user, str(day(9)))).items()}
    assert [n for n, s in got.items() if s == "train"] == [1, 2, 3, 5, 8]
    assert got[46] == "test"
    first_only = {n: r.split for n, r in by_day(b.split_by_date(one_user, str(day(1)))).items()}
    assert first_only[1] == "test" and first_only[2] is None
    with pytest.raises(ValueError):
        b.split_by_date(one_user, "2030-01-01", require_observed=True)


def test_other_users_and_row_order_do_not_matter(one_user, series):
    alone = sorted(map(tuple, b.with_baselines(one_user, [FEATURE]).collect()))
    crowd = one_user.union(series({2: {n: 5.0 for n in range(1, 40)}})).repartition(7).orderBy(F.rand(3))
    among = b.with_baselines(crowd, [FEATURE]).filter("user_id = 1")
    assert sorted(map(tuple, among.collect())) == alone


def test_one_shuffle_by_user(one_user):
    spread = one_user.repartition(4)
    plan = b.with_baselines(spread, [FEATURE])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
