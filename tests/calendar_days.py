"""Day numbers as dates."""

import datetime as dt

START = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    """Day number n, 1 = 2024-01-01."""
    return START + dt.timedelta(days=n - 1)
