"""A user's own past as the yardstick of each day.

Days are addressed by their position among the user's observed days (``idx``), gaps unfilled.
For a day t the week anchor is the earliest observed day of t−6 … t−1, or the one before it
when that is the previous observed day; the month anchor is the earliest of t−29 … t−1, or the
one before it when that is the week anchor. Every mean between two anchors is the content of
a window frame, or of a frame and one neighbouring day: one shuffle by user, no self-join,
and a user contributes one row per day however many commands were typed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Look-back of the two anchors in days.
WEEK_DAYS = 6
MONTH_DAYS = 29


def _by_day():
    return W.partitionBy("user_id").orderBy("dn")


def day_index(series: DataFrame) -> DataFrame:
    """Add ``idx``, the 1-based position of each day among the user's observed days."""
    return _indexed(series).drop("dn")


def _indexed(series: DataFrame) -> DataFrame:
    numbered = series.withColumn("dn", F.unix_date("day"))
    return numbered.withColumn("idx", F.row_number().over(_by_day()))


def _anchored(series: DataFrame) -> DataFrame:
    """Add idx, previous day, week_idx and month_idx; an anchor that does not exist is NULL."""

    def earliest(days: int) -> Column:
        return F.min("idx").over(_by_day().rangeBetween(-days, -1))

    def existing(position: Column) -> Column:
        return F.nullif(position, F.lit(0))

    wi, mi, idx, week = F.col("wi"), F.col("mi"), F.col("idx"), F.col("week_idx")
    return (
        _indexed(series)
        .withColumns(
            {
                "prev_day": F.lag("day").over(_by_day()),
                "wi": earliest(WEEK_DAYS),
                "mi": earliest(MONTH_DAYS),
            }
        )
        .withColumn("week_idx", existing(F.when(wi == idx - 1, wi - 1).otherwise(wi)))
        .withColumn(
            "month_idx",
            F.when(week.isNotNull(), existing(F.when(mi == week, mi - 1).otherwise(mi))),
        )
    )


def anchors(series: DataFrame) -> DataFrame:
    """idx, previous observed day and the positions of both anchors for every user-day."""
    return _anchored(series).select("user_id", "day", "idx", "prev_day", "week_idx", "month_idx")


def with_baselines(series: DataFrame, features: Sequence[str], week_mode: str = "mean") -> DataFrame:
    """Add ``<f>_prev``, ``<f>_week``, ``<f>_month`` and ``<f>_ok`` for every feature column.

    ``week_mode="mean"`` averages the days from the week anchor to the previous day;
    ``"last"`` takes the previous day's value alone. The month baseline averages the days
    between the two anchors, both included. Days on which a feature is NULL do not enter its
    means. ``<f>_ok`` tells a day that was compared from one that could not be.
    """
    if week_mode not in ("mean", "last"):
        raise ValueError(f"unknown week_mode {week_mode!r}")
    framed = _anchored(series).select("*", *[c for f in features for c in _frames(f)])
    means = framed.select(
        *series.columns,
        "idx",
        "prev_day",
        "week_idx",
        "month_idx",
        *[c for f in features for c in _means(f, week_mode)],
    )
    return means.withColumns({f"{f}_ok": _compared(f) for f in features})


def _frames(feature: str) -> list[Column]:
    """Everything the means of one feature are put together from."""
    w, value = _by_day(), F.col(feature).cast("double")
    week = w.rangeBetween(-WEEK_DAYS, -1)
    older = w.rangeBetween(-MONTH_DAYS, -WEEK_DAYS - 1)
    return [
        F.lag(value).over(w).alias(f"{feature}_prev"),
        F.avg(value).over(week).alias(f"{feature}_week_days"),
        F.first(value).over(week).alias(f"{feature}_week_first"),
        F.sum(value).over(older).alias(f"{feature}_older_sum"),
        F.count(value).over(older).alias(f"{feature}_older_n"),
        F.last(value)
        .over(w.rangeBetween(W.unboundedPreceding, -MONTH_DAYS - 1))
        .alias(f"{feature}_before_month"),
        F.avg(value).over(w.rowsBetween(-2, -1)).alias(f"{feature}_last_two"),
        F.avg(value).over(w.rowsBetween(-3, -2)).alias(f"{feature}_two_before"),
    ]


def _means(feature: str, week_mode: str) -> list[Column]:
    """Previous value, week mean and month mean of one feature.

    With several observed days in the week, the week mean is that of the week's frame, and the
    month runs from the month's first day to the week's first: the days older than the week
    (or, if there are none, the one day before the month) and the week's first day. When the
    previous day is the week's only one, the week anchor is the day before it, and the month
    ends there.
    """
    idx, wi, mi = F.col("idx"), F.col("wi"), F.col("mi")
    part = {
        n: F.col(f"{feature}_{n}")
        for n in ("prev", "week_days", "week_first", "older_sum", "older_n", "before_month",
                  "last_two", "two_before")
    }
    alone = wi == idx - 1
    week = F.when(alone, part["last_two"]).otherwise(part["week_days"])
    if week_mode == "last":
        week = part["prev"]

    def present(value: Column) -> Column:
        return F.when(value.isNotNull(), 1).otherwise(0)

    zero = F.lit(0.0)
    no_older = mi == wi
    low_sum = F.when(no_older, part["before_month"]).otherwise(part["older_sum"])
    low_n = F.when(no_older, present(part["before_month"])).otherwise(part["older_n"])
    month = (
        F.when(alone & (mi == idx - 1), part["last_two"])
        .when(alone & (mi == idx - 2), part["two_before"])
        .when(alone, F.try_divide(part["older_sum"], part["older_n"]))
        .otherwise(
            F.try_divide(
                F.coalesce(low_sum, zero) + F.coalesce(part["week_first"], zero),
                low_n + present(part["week_first"]),
            )
        )
    )
    return [
        part["prev"],
        F.when(F.col("week_idx").isNotNull(), week).alias(f"{feature}_week"),
        F.when(F.col("month_idx").isNotNull(), month).alias(f"{feature}_month"),
    ]


def _compared(feature: str) -> Column:
    parts = [F.col(feature), F.col(f"{feature}_week"), F.col(f"{feature}_month")]
    return parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()


def split_by_date(series: DataFrame, test_from: str, require_observed: bool = False) -> DataFrame:
    """Add ``split``: a user's days before their first observed day from ``test_from`` on are
    'train', that day and the later ones are 'test'.

    When the test would begin on the very first observed day there is nothing to learn from:
    that day alone is 'test' and later days have no split. ``require_observed`` raises
    when nobody was active on ``test_from`` itself.
    """
    start = F.lit(test_from).cast("date")
    if require_observed and series.filter(F.col("day") == start).isEmpty():
        raise ValueError(f"no data on {test_from}")
    indexed = _indexed(series)
    first_test = F.min(F.when(F.col("day") >= start, F.col("idx"))).over(W.partitionBy("user_id"))
    idx, k = F.col("idx"), F.col("first_test")
    split = (
        F.when(k == 1, F.when(idx == 1, "test"))
        .when(k.isNull() | (idx < k), "train")
        .otherwise("test")
    )
    return indexed.withColumn("first_test", first_test).withColumn("split", split).drop("dn")


def frozen_baselines(
    series: DataFrame, features: Sequence[str], test_from: str, week_mode: str = "mean"
) -> DataFrame:
    """Test days compared with the baselines of the user's first test day instead of their own."""
    rolling = with_baselines(series, features, week_mode)
    split = split_by_date(rolling, test_from)
    everyone = W.partitionBy("user_id")
    at_start = F.col("idx") == F.col("first_test")
    names = [f"{f}_{part}" for f in features for part in ("prev", "week", "month")]
    held = split.withColumns(
        {n: F.max(F.when(at_start, F.col(n))).over(everyone) for n in names}
    )
    compared = {f"{f}_ok": _compared(f) for f in features}
    return held.filter(F.col("split") == "test").withColumns(compared).drop("first_test", "split")
