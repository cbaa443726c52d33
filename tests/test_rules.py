import pytest
from calendar_days import START, day
from pyspark.sql import functions as F

from userbaseline.operators import rules
from userbaseline.operators.baselines import with_baselines


@pytest.fixture(scope="module")
def flagged(spark):
    def run(rule, *cases):
        df = spark.createDataFrame(cases, "v double, d double, w double, m double")
        out = df.select(rules.flag(F.col("v"), F.col("d"), F.col("w"), F.col("m"), rule).alias("f"))
        return [r.f for r in out.collect()]

    return run


def test_high(flagged):
    got = flagged(
        rules.HIGH,
        (16.0, 10.0, 10.0, 10.0),
        (15.0, 10.0, 10.0, 10.0),  # equal to the day limit
        (14.5, 9.0, 10.0, 10.0),
        (16.0, 10.0, 12.0, 10.0),  # week
        (16.0, 10.0, 10.0, 13.0),  # month
    )
    assert got == [1, 0, 1, 0, 0]


def test_low(flagged):
    got = flagged(
        rules.LOW,
        (0.2, 1.0, 1.0, 1.0),
        (0.35, 1.0, 1.0, 1.0),
        (0.0, 1.0, 1.0, 1.0),
        (0.0, 1.0, 0.0, 1.0),  # not below 0
    )
    assert got == [1, 0, 1, 0]


def test_without_a_previous_day_the_week_and_month_decide(flagged):
    got = flagged(rules.HIGH, (16.0, None, 10.0, 10.0), (16.0, 0.0, 10.0, 10.0), (13.5, 0.0, 10.0, 10.0))
    assert got == [1, 1, 0]


def test_missing_value_or_baseline_gives_no_flag(flagged):
    got = flagged(rules.HIGH, (None, 1.0, 1.0, 1.0), (9.0, 1.0, None, 1.0), (9.0, 1.0, 1.0, None))
    assert got == [0, 0, 0]


def test_flags_on_paper(series):
    days = [1, 2, 3, 5, 8, 9, 15, 16, 30, 31, 45, 46]
    values = [2, 4, 6, 1, 3, 5, 8, 7, 2, 9, 4, 6]
    compared = with_baselines(series({1: dict(zip(days, map(float, values)))}), ["sessions_per_day"])
    rows = compared.select("day", rules.flag_of("sessions_per_day").alias("f")).collect()
    assert sorted((r.day - START).days + 1 for r in rows if r.f == 1) == [15, 31]


@pytest.fixture(scope="module")
def features(spark):
    rows = []
    for n in range(1, 32):
        odd = n == 31
        rows.append((1, day(n), 9.0 if odd else 2.0, 8.0 if odd else 3.0, 600.0 if odd else 60.0,
                     0.1 if odd else 0.9, 0.9 if odd else 0.1, 0.05 if odd else 0.8))
    return spark.createDataFrame(
        rows,
        "user_id long, day date, sessions_per_day double, cmd_per_day double, sess_dur double, "
        "good_cmd double, bad_cmd double, five_cmd_match double",
    )


def test_matrix_columns_and_an_odd_day(features):
    out = rules.flags(features)
    assert out.columns == ["user_id", "day", *rules.FLAGS, "baseline_ok"]
    assert rules.FLAGS == (
        "sessions_per_day", "cmd_per_day", "good_cmd", "bad_cmd", "five_cmd_match", "sess_dur",
    )
    rows = {r.day: r for r in out.collect()}
    assert [rows[day(31)][f] for f in rules.FLAGS] == [1] * 6
    assert rows[day(31)].baseline_ok
    assert all(rows[day(n)][f] == 0 for n in range(1, 31) for f in rules.FLAGS)
    assert not rows[day(1)].baseline_ok


def test_scaling_a_series_does_not_change_flags(features):
    scaled = features.withColumns({f: F.col(f) * 4.0 for f in rules.FLAGS})
    assert sorted(rules.flags(features).collect()) == sorted(rules.flags(scaled).collect())


def test_frozen(features):
    out = rules.flags(features, anchor="frozen", week_mode="last", test_from=str(day(20)))
    assert out.count() == 12
    with pytest.raises(ValueError):
        rules.flags(features, anchor="frozen")
    with pytest.raises(ValueError):
        rules.flags(features, anchor="sliding")
