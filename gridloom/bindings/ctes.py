"""The views of `tables.py` as SQL, written independently with plain window frames."""

from __future__ import annotations

from gridloom import dims

CH = dims.CHANNELS
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_KEY = (f"{_list(dims.VARIABLES)}[CAST(event_id % 6 AS INT) + 1] || '_' || "
        f"{_list([n for n, _, _ in dims.NODES])}[CAST(user_id % 19 AS INT) + 1]")


def _bin(ts: str) -> str:
    return f"time_bucket(INTERVAL 15 MINUTE, {ts})"


_AGGS = """
  CAST(sum(CASE WHEN event_type = 'purchase' THEN cents END) AS DOUBLE) AS price,
  CAST(sum(CASE WHEN event_type = 'view' THEN cents END) AS DOUBLE) AS load,
  CAST(sum(CASE WHEN event_type = 'click' THEN cents END) AS DOUBLE) AS solar,
  CAST(sum(CASE WHEN event_type = 'error' THEN cents END) AS DOUBLE) AS wind,
  CAST(sum(CASE WHEN event_type = 'signup' THEN cents END) AS DOUBLE) AS hydro,
  CAST(sum(CASE WHEN event_type IN ('click', 'error') THEN cents END) AS DOUBLE) AS renewable_total,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN k END) AS DOUBLE) AS bidspace,
  CAST(sum(CASE WHEN event_type = 'error' THEN k END) AS DOUBLE) AS reserve,
  CAST(sum(CASE WHEN event_type = 'click' THEN k END) AS DOUBLE) AS nonmarket,
  CAST(sum(CASE WHEN event_type = 'signup' THEN -k END) AS DOUBLE) AS tieline,
  CAST(sum(CASE WHEN event_type = 'view' THEN cents + k END) AS DOUBLE) AS load_tie"""


def _regular(raw: str, step: str = "15 MINUTE") -> str:
    return (f"SELECT s.series_id, s.ts, r.* EXCLUDE (series_id, ts) FROM (SELECT series_id, "
            f"unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {raw} GROUP BY series_id) s "
            f"LEFT JOIN {raw} r ON r.series_id = s.series_id AND r.ts = s.ts")


def _filled(src: str) -> str:
    cols = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in CH)
    return (f"SELECT series_id, ts, {cols} FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY ts "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _json(keys: str, src: str) -> str:
    """Rows to one JSON object, keys in order."""
    return (f"SELECT {keys}, '{{' || string_agg('\"' || key || '\":' || CAST(value AS VARCHAR), ',' ORDER BY key) || '}}' AS variables "
            f"FROM {src} GROUP BY {keys}")


CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], "SELECT event_id, ts, user_id, event_type, value, round(value * 100) AS cents, "
               "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "raw_grid": (["ev"], f"SELECT CAST(user_id % 4 AS INTEGER) AS series_id, {_bin('ts')} AS ts, {_AGGS} FROM ev GROUP BY 1, 2"),
    "raw_fine": (["ev"], f"SELECT CAST(user_id % 50 AS INTEGER) AS series_id, {_bin('ts')} AS ts, count(*) AS n FROM ev GROUP BY 1, 2"),
    "ev_year": (["ev"], "SELECT * REPLACE (ts + to_days(CAST((user_id // 2) % 12 * 30 AS INTEGER)) AS ts) FROM ev"),
    "raw_year": (["ev_year"], f"SELECT CAST(user_id % 2 AS INTEGER) AS series_id, {_bin('ts')} AS ts, {_AGGS} FROM ev_year GROUP BY 1, 2"),
    "gap_grid": (["raw_grid"], _regular("raw_grid")),
    "grid": (["gap_grid"], _filled("gap_grid")),
    "gap_year": (["raw_year"], _regular("raw_year")),
    "year_grid": (["gap_year"], _filled("gap_year")),
    "wx_long": (["ev"], f"SELECT date_trunc('hour', ts) AS ts, {_KEY} AS key, avg(k) AS value FROM ev GROUP BY 1, 2"),
    "wx_obs": (["wx_long"], _json("ts", "wx_long")),
    "wx_long_year": (["ev_year"], f"SELECT date_trunc('hour', ts) AS ts, {_KEY} AS key, avg(k) AS value FROM ev_year GROUP BY 1, 2"),
    "wx_obs_year": (["wx_long_year"], _json("ts", "wx_long_year")),
    "run_long": (["ev"], "SELECT date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS fetch_time, "
                         f"date_trunc('hour', ts) + to_days(CAST(1 + event_id % 2 AS INTEGER)) AS target_time, {_KEY} AS key, avg(k) AS value "
                         "FROM ev GROUP BY 1, 2, 3"),
    "runs": (["run_long"], _json("fetch_time, target_time", "run_long")),
    "best_run": (["runs"], "SELECT target_time, max(fetch_time) AS fetch_time FROM runs GROUP BY 1"),
    "weather": (["wx_obs", "runs", "best_run"],
                "SELECT ts, variables FROM wx_obs UNION ALL SELECT r.target_time, r.variables FROM runs r "
                "JOIN best_run b ON b.target_time = r.target_time AND b.fetch_time = r.fetch_time "
                "WHERE r.target_time NOT IN (SELECT ts FROM wx_obs)"),
    "lagged": (["grid"], "SELECT series_id, ts, price, lag(price, 96) OVER w AS l96, lag(price, 192) OVER w AS l192, "
                         "lag(price, 672) OVER w AS l672 FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY ts)"),
    "predictions": (["lagged"],
                    "SELECT series_id, ts AS target_time, l96 * 0.7::DOUBLE + l672 * 0.3::DOUBLE AS predicted_price, 'v' AS model_version FROM lagged "
                    "WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 2 = 0 AND l96 IS NOT NULL AND l672 IS NOT NULL "
                    "UNION ALL SELECT series_id, ts, l192, 'v_lag192' FROM lagged WHERE l192 IS NOT NULL"),
    "split_in": (["year_grid"],
                 "SELECT series_id, ts, price, lead(price, 96) OVER w AS y_price, lag(price, 96) OVER w AS price_lag96, "
                 "lag(price, 192) OVER w AS price_lag192, lag(price, 672) OVER w AS price_lag672 FROM year_grid "
                 "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"),
}


def ora(body: str, *needs: str, **extra: str) -> str:
    """A statement over the named views and any extra common tables, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


W = "(PARTITION BY series_id ORDER BY ts)"
PERIOD = "CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER)"
DAY = "CAST(ts AS DATE)"


def period_of(ts: str = "ts") -> str:
    return f"CAST(hour({ts}) * 4 + minute({ts}) // 15 AS INTEGER)"
