"""Flags: a day's value against the previous day, the week and the month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.operators.baselines import frozen_baselines, with_baselines


@dataclass(frozen=True)
class Rule:
    """Flag a value above (``high``) or below (``low``) all three multiples of its baselines."""

    direction: str
    k_prev: float
    k_week: float
    k_month: float


# The factors of both rule families, and the column order of the flag matrix.
HIGH = Rule("high", 1.5, 1.4, 1.3)
LOW = Rule("low", 0.5, 0.4, 0.3)
RULES = {
    "sessions_per_day": HIGH,
    "cmd_per_day": HIGH,
    "good_cmd": LOW,
    "bad_cmd": HIGH,
    "five_cmd_match": LOW,
    "sess_dur": HIGH,
}
FLAGS = tuple(RULES)


def flag(value: Column, prev: Column, week: Column, month: Column, rule: Rule) -> Column:
    """1 when the value is strictly beyond every baseline, else 0.

    A previous-day value that is missing or 0 is not tested; a missing value, week or month
    baseline gives 0.
    """

    def beyond(factor: float, baseline: Column) -> Column:
        limit = F.lit(factor) * baseline
        return value > limit if rule.direction == "high" else value < limit

    day_test = F.coalesce(beyond(rule.k_prev, F.nullif(prev, F.lit(0.0))), F.lit(True))
    hit = value.isNotNull() & day_test & beyond(rule.k_week, week) & beyond(rule.k_month, month)
    return F.when(hit, 1).otherwise(0)


def flag_of(feature: str, rule: Rule | None = None) -> Column:
    """The flag of one feature on a table that carries its baselines."""
    return flag(
        F.col(feature).cast("double"),
        F.col(f"{feature}_prev"),
        F.col(f"{feature}_week"),
        F.col(f"{feature}_month"),
        rule or RULES[feature],
    )


def flags(
    features: DataFrame,
    anchor: str = "rolling",
    week_mode: str = "mean",
    test_from: str | None = None,
) -> DataFrame:
    """The flag matrix: (user_id, day), six flags in fixed order, ``baseline_ok``.

    ``anchor="rolling"`` compares each day with its own past; ``"frozen"`` compares every day
    from ``test_from`` on with the baselines of the user's first such day.
    """
    if anchor == "rolling":
        compared = with_baselines(features, FLAGS, week_mode)
    elif anchor == "frozen":
        if test_from is None:
            raise ValueError("frozen baselines need test_from")
        compared = frozen_baselines(features, FLAGS, test_from, week_mode)
    else:
        raise ValueError(f"unknown anchor {anchor!r}")
    complete = F.lit(True)
    for f in FLAGS:
        complete = complete & F.col(f"{f}_ok")
    return compared.select(
        "user_id",
        "day",
        *[flag_of(f).alias(f) for f in FLAGS],
        complete.alias("baseline_ok"),
    )
