"""Text time labels of the landed feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(day: Column, hhmm: Column) -> Column:
    """Date plus HHMM; hour 24 runs into the next day by itself."""
    minutes = F.floor(hhmm / 100) * 60 + F.pmod(hhmm, F.lit(100))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def parse_time_label(label: Column) -> Column:
    """`"YYMMDD HHMM"` to a timestamp; a malformed label gives null."""
    text = F.trim(label)
    ok = text.rlike(r"^\d{6}\s+\d{4}$")
    day = F.try_to_date(F.concat(F.lit("20"), F.substring(text, 1, 6)), "yyyyMMdd")
    hhmm = F.regexp_extract(text, r"(\d{4})$", 1).try_cast("int")
    return F.when(ok & (F.floor(hhmm / 100) <= 24) & (F.pmod(hhmm, F.lit(100)) < 60), _at(day, hhmm))


def parse_sheet_time(day: Column, hhmm: Column) -> Column:
    """Sheet date (`-` or `/`) and an HHMM number, as the interval end."""
    parsed = F.try_to_date(F.regexp_replace(F.trim(day), "/", "-"), "yyyy-M-d")
    return _at(parsed, hhmm.try_cast("int"))


def interval_start(end: Column, minutes: int = 15) -> Column:
    return end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def local_from_epoch(seconds: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds to wall-clock time of a zone."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
