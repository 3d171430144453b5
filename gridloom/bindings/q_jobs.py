"""The jobs over a prediction store: gap pass, back-fill, curves read from pruned partitions.

The forecasts are the naive ones (the mean of lagged prices), so that SQL can say every value; the
same jobs run with the two-stage models in `q_models` and in the tests.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridloom.bindings import tables as t
from gridloom.bindings.ctes import ora, period_of
from gridloom.bindings.q_quality import CURVE, PREFERRED
from gridloom.bindings.registry import query
from gridloom.operators import regular
from gridloom.operators.daily import last_day
from gridloom.operators.shift import lag_by
from gridloom.plans import jobs, serving
from gridloom.session import materialise, work_path
from gridloom.sources import store

NORMAL, GAP = t.VERSION, t.GAP_VERSION
LAGS = {"price_lag96": ("price", 96), "price_lag192": ("price", 192), "price_lag672": ("price", 672)}
NORMAL_LAGS, GAP_LAGS = ("price_lag96", "price_lag672"), ("price_lag192", "price_lag672")


def _inputs(spark, sf, extend: int = 0):
    """Stored rows with the lagged prices, the grid extended past its end."""
    grid = t.grid(spark, sf).select(*t.SERIES, "ts", "price")
    grid = regular.forward_extend(grid, extend, series=t.SERIES) if extend else grid
    return materialise(lag_by(grid, LAGS, series=t.SERIES), "lagged")


_EXTENDED = ("SELECT s.series_id, s.ts, g.price FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts) + INTERVAL 48 HOUR, INTERVAL 15 MINUTE)) AS ts FROM grid GROUP BY 1) s "
             "LEFT JOIN grid g ON g.series_id = s.series_id AND g.ts = s.ts")
_LAGGED = ("SELECT series_id, ts, ts + INTERVAL 24 HOUR AS target_time, lag(price, 96) OVER w AS l96, lag(price, 192) OVER w AS l192, lag(price, 672) OVER w AS l672, "
           "max(CASE WHEN known THEN ts END) OVER (PARTITION BY series_id) AS end_ts FROM (SELECT e.*, ts <= (SELECT max(ts) FROM grid g WHERE g.series_id = e.series_id) AS known FROM ext e) "
           "WINDOW w AS (PARTITION BY series_id ORDER BY ts)")


def _records(rows: str, near: str, version: str) -> str:
    """All periods of the target dates of `rows`, 0 where nothing is known."""
    return (f"SELECT d.series_id, d.day + to_minutes(CAST(p.p * 15 AS BIGINT)) AS target_time, "
            f"coalesce(CASE WHEN r.{near} IS NOT NULL AND r.l672 IS NOT NULL THEN (r.{near} + r.l672) / 2 ELSE coalesce(r.{near}, r.l672) END, 0) AS predicted_price, "
            f"'{version}' AS model_version, CASE WHEN month(d.day) <= 4 THEN 'dry' ELSE 'wet' END AS season, CAST(p.p AS INTEGER) AS period "
            f"FROM (SELECT DISTINCT series_id, CAST(CAST(target_time AS DATE) AS TIMESTAMP) AS day FROM {rows}) d CROSS JOIN range(96) p(p) "
            f"LEFT JOIN {rows} r ON r.series_id = d.series_id AND r.target_time = d.day + to_minutes(CAST(p.p * 15 AS BIGINT))")


_VIEWS = {
    "ext": _EXTENDED, "lg": _LAGGED,
    "all_rows": "SELECT * FROM lg WHERE ts <= end_ts",
    "gap_rows": "SELECT * FROM lg WHERE CAST(target_time AS DATE) > CAST(end_ts + INTERVAL 24 HOUR AS DATE)",
    "last_rows": "SELECT * FROM lg WHERE ts <= end_ts AND ts > end_ts - INTERVAL 24 HOUR",
}
_GAP_SQL = _records("gap_rows", "l192", GAP)
_COLUMNS = ["series_id", "target_time", "predicted_price", "model_version", "season", "period"]


@query("gap_pass", ora(f"{_records('last_rows', 'l96', NORMAL)} UNION ALL {_GAP_SQL}", "grid", **_VIEWS))
def gap_pass(spark, sf):
    """The daily store write: whole dates from the last day of each series, then the dates after them from lagged inputs."""
    path = work_path(spark, "predictions")
    normal = materialise(jobs.full_days(jobs.by_anchor(NORMAL_LAGS)(last_day(_inputs(spark, sf), series=t.SERIES)), NORMAL), "normal")
    store.replace_predictions(normal, path)
    gap = jobs.gap_pass(_inputs(spark, sf, jobs.GAP_STEPS), jobs.by_anchor(GAP_LAGS), version=GAP, normal=normal)
    store.replace_predictions(materialise(gap, "gap"), path)
    return spark.read.parquet(path).select(*_COLUMNS)


def backfilled(spark, sf) -> str:
    """A store with gap rows of earlier days, back-filled in steps of a week: all dates, then those after them."""
    path, ledger = work_path(spark, "predictions"), work_path(spark, "ledger")
    old = t.predictions(spark, sf).where(F.col("model_version") == GAP)
    season = F.lit("old").alias("season")
    store.replace_predictions(old.select(*_COLUMNS[:4], season, F.lit(0).alias("period")), path)
    jobs.backfill(_inputs(spark, sf), jobs.by_anchor(NORMAL_LAGS), path=path, ledger_path=ledger, run="r", version=NORMAL, step_days=7)
    jobs.backfill(_inputs(spark, sf, jobs.GAP_STEPS), jobs.by_anchor(GAP_LAGS), path=path, ledger_path=ledger, run="r", version=GAP,
                  after=NORMAL, step_days=7)
    return path


_BACKFILL = f"{_records('all_rows', 'l96', NORMAL)} UNION ALL {_GAP_SQL}"


@query("backfill", ora(_BACKFILL, "grid", **_VIEWS))
def backfill(spark, sf):
    """Every date of the history and the dates after it; superseded gap rows are gone."""
    return spark.read.parquet(backfilled(spark, sf)).select(*_COLUMNS)


SINCE = date(2024, 1, 15)
_CURVE_VIEWS = {
    **_VIEWS, "predictions": _BACKFILL, "pref": PREFERRED, "curve": CURVE,
    "latest": f"SELECT series_id, max(day) AS day FROM (SELECT series_id, CAST(target_time AS DATE) AS day FROM predictions WHERE target_time >= TIMESTAMP '{SINCE}' GROUP BY 1, 2 HAVING count(DISTINCT target_time) >= 96) GROUP BY 1",
}


@query("stored_day_curve", ora("SELECT c.* FROM curve c JOIN latest l ON l.series_id = c.series_id AND l.day = c.day", "grid", **_CURVE_VIEWS))
def stored_day_curve(spark, sf):
    """Curve of the latest complete day, read from the back-filled store; only that day's partitions are read whole."""
    return serving.stored_day_curve(spark, backfilled(spark, sf), [NORMAL, GAP], keys=t.SERIES, since=SINCE)


@query("stored_history", ora(
    f"SELECT s.series_id, CAST(s.ts AS DATE) AS day, {period_of('s.ts')} AS period, round_even(a.price, 1) AS actual, round_even(p.predicted_price, 1) AS predicted FROM "
    "(SELECT series_id, unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-03 23:45:00', INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT series_id FROM raw_grid)) s "
    "LEFT JOIN raw_grid a ON a.series_id = s.series_id AND a.ts = s.ts LEFT JOIN pref p ON p.series_id = s.series_id AND p.target_time = s.ts", "raw_grid", "grid",
    **{k: v for k, v in _CURVE_VIEWS.items() if k not in ("curve", "latest")}))
def stored_history(spark, sf):
    """History of a range from the store, the series named by a table of their own."""
    raw = t.raw_grid(spark, sf)
    series = materialise(raw.select(*t.SERIES).distinct(), "series")
    pred = store.read_predictions(spark, backfilled(spark, sf), [NORMAL, GAP])
    return serving.history_compare(raw, pred, F.lit(date(2024, 1, 20)), F.lit(date(2024, 2, 3)), [NORMAL, GAP], keys=t.SERIES, series=series)
