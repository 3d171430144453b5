"""Missing values filled level by level, so that no input of a model is null unnoticed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.timegrid import QUARTER, col
from gridloom.operators import quantiles, regular
from gridloom.session import materialise

GROUP = ["_season", "_day_type", "_period"]


def hierarchical_fill(grid: DataFrame, cols: Sequence[str], *, series: Sequence[str] = ("series_id",), ts: str = "ts", carry: int = 4, minutes: int = QUARTER) -> DataFrame:
    """The grid with gaps filled, and `<c>_level` for each column: 0 measured, 1 carried at most `carry` steps, 2 median of the
    measured values of the same season, day type and period of the series, 3 still missing.

    Medians are exact for groups of any size (see `exact_quantiles`). They are
    joined to the gaps alone, by series, group and month, so that the gaps of one
    series do not meet in one task; rows without gaps take no part.
    """
    series = list(series)
    labels = {"_season": F.coalesce(calendar.season(col(ts)), F.lit("none")), "_day_type": calendar.day_type(col(ts)), "_period": calendar.period(col(ts)),
              "_month": F.trunc(F.to_date(col(ts)), "month")}
    kept = grid.select(*grid.columns, *[col(c).alias(f"raw~{c}") for c in cols])
    filled = materialise(regular.ffill(kept, list(cols), series=series, ts=ts, limit=carry, minutes=minutes).withColumns(labels), "carried")
    missing = filled.where(" OR ".join(f"`{c}` IS NULL" for c in cols))
    whole = filled.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    months = missing.select(*series, "_month").distinct()
    for c in cols:
        medians = quantiles.exact_quantiles(filled.select(*series, *GROUP, col(f"raw~{c}").alias("_x")), "_x", [0.5], by=[*series, *GROUP])
        per_month = medians.join(months, series) if series else medians.crossJoin(F.broadcast(months))
        found = per_month.select(*[col(k).alias(f"_j{i}") for i, k in enumerate([*series, *GROUP, "_month"])], F.col("q0").alias(f"_median_{c}"))
        on = [col(k) == F.col(f"_j{i}") for i, k in enumerate([*series, *GROUP, "_month"])]
        missing = missing.join(found, on, "left").drop(*[f"_j{i}" for i in range(len(series) + len(GROUP) + 1)])
    whole = whole.withColumns({f"_median_{c}": F.lit(None).cast("double") for c in cols})
    both = whole.unionByName(missing)
    level = lambda c: F.when(col(f"raw~{c}").isNotNull(), 0).when(col(c).isNotNull(), 1).when(F.col(f"_median_{c}").isNotNull(), 2).otherwise(3)
    out = both.withColumns({f"{c}_level": level(c) for c in cols}).withColumns({c: F.coalesce(col(c), F.col(f"_median_{c}")) for c in cols})
    return out.select(*grid.columns, *[f"{c}_level" for c in cols])


def refuse_nulls(df: DataFrame, cols: Sequence[str], message: str = "a model input is missing") -> DataFrame:
    """The same rows; the job fails when one of the columns is null or not a number."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | col(c).isNull() | F.isnan(col(c).cast("double"))
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
