"""Times and columns the tests of the grid share."""

from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def at(step, start=START, minutes=15):
    return start + timedelta(minutes=minutes * step)


def column(df, name, keys=("series_id", "ts")):
    return [r[name] for r in df.orderBy(*keys).select(name).collect()]
