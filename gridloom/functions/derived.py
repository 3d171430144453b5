"""Scalar formulas on weather, generation and price columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.calendar import flag

COMFORT = 18.0
ENERGY_RESERVE = 6000.0


def cooling_degrees(temp: Column) -> Column:
    return F.when(temp.isNotNull(), F.greatest(temp - COMFORT, F.lit(0.0)))


def heating_degrees(temp: Column) -> Column:
    return F.when(temp.isNotNull(), F.greatest(F.lit(COMFORT) - temp, F.lit(0.0)))


def apparent_temperature(temp: Column, humidity: Column) -> Column:
    return temp * 1.07 + humidity * 0.2 - 2.7


def cubic(x: Column) -> Column:
    return x * x * x


def effective_radiation(rad: Column, cloud: Column) -> Column:
    clear = F.when(cloud.isNotNull(), F.greatest(1.0 - cloud / 100.0, F.lit(0.0)))
    return rad * clear


def is_daytime(rad: Column) -> Column:
    return flag(rad > 10.0)


def is_generating(wind_speed: Column) -> Column:
    return flag((wind_speed > 3.0) & (wind_speed < 25.0))


def rain_squared(x: Column) -> Column:
    return x * x


def rain_root(x: Column) -> Column:
    return F.sqrt(x + 0.01)


def share(part: Column, load: Column) -> Column:
    """Part of the load; one unit is added so that an idle system is defined."""
    return F.try_divide(part, load + 1)


def net_load(load: Column, solar: Column, wind: Column, hydro: Column) -> Column:
    return load - solar - wind - hydro


def surplus(load: Column, solar: Column, wind: Column, hydro: Column) -> Column:
    return solar + wind + hydro * 0.3 - load + ENERGY_RESERVE


def renewable(solar: Column, wind: Column, hydro: Column) -> Column:
    return solar + wind + hydro


def mean_of_available(cols: list[Column]) -> Column:
    """Mean of the values present in a row; null if there is none."""
    total, count = F.lit(0.0), F.lit(0)
    for c in cols:
        total = total + F.coalesce(c, F.lit(0.0))
        count = count + c.isNotNull().cast("int")
    return F.try_divide(total, count.cast("double"))


def robust_weight(y: Column, scale: Column) -> Column:
    """Sample weight that falls with the size of the target."""
    return 1.0 / (1.0 + F.abs(y) / (scale + 1e-6))
