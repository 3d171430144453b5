"""All registered queries."""

from gridloom.bindings import q_calendar, q_series, q_daily, q_ingest, q_jobs, q_landed, q_quality, q_features, q_models, q_stream, q_watch  # noqa: F401
from gridloom.bindings.registry import RUNS, SQL  # noqa: F401
