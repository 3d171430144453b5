"""Landing JSON into the stored grid, reading ranges of it."""

import json
import os
from datetime import datetime

import pytest

from gridloom.bindings import catalog
from gridloom.plans import jobs
from gridloom.sources import tables as src

DATA = "/root/testdata/sf0.001"


def land(folder, fetched, series, code, points):
    """A payload file a series, as a fetch leaves it."""
    where = folder / f"fetched={fetched}" / f"series_id={series}"
    where.mkdir(parents=True, exist_ok=True)
    feed = {"legendCode": "provincialLoad0", "legendName": "realtime", "xAxisYYList": list(points), "yAxisList": list(points.values())}
    (where / "a.json").write_text(json.dumps({"code": code, "data": {"provincialLoadEchartsDataList": [feed]}}), encoding="utf-8")


def stored(spark, table):
    return {(r.series_id, r.ts): (r.fetched, r.load) for r in src.read_grid(spark, table, extra=["series_id", "fetched"]).collect()}


def test_an_older_fetch_that_comes_last_loses(spark, tmp_path):
    table = str(tmp_path / "grid")
    new, old = tmp_path / "new", tmp_path / "old"
    land(new, 5, 1, 200, {"260630 2400": 10.0, "260701 0015": 11.0})
    land(old, 4, 1, 200, {"260701 0015": 1.0, "260701 0030": 2.0, "260701 0045": -1.0})
    land(old, 4, 2, 500, {"260701 0015": 7.0})
    jobs.land_grid(spark, str(new), table)
    untouched = os.listdir(f"{table}/month=202606")
    for _ in range(2):  # landing the same files again changes nothing
        jobs.land_grid(spark, str(old), table)
        assert stored(spark, table) == {(1, datetime(2026, 6, 30, 23, 45)): (5, 10.0), (1, datetime(2026, 7, 1)): (5, 11.0), (1, datetime(2026, 7, 1, 0, 15)): (4, 2.0)}
    assert sorted(os.listdir(table))[-2:] == ["month=202606", "month=202607"]
    assert os.listdir(f"{table}/month=202606") == untouched  # not rewritten


def test_range_of_a_table_without_months(spark, tmp_path):
    path = str(tmp_path / "flat")
    rows = [(datetime(2026, m, 1), float(m)) for m in range(1, 7)]
    spark.createDataFrame(rows, "ts timestamp_ntz, load double").write.parquet(path)
    assert sorted(r.load for r in src.read_grid(spark, path, start="2026-02-01", end="2026-04-01").collect()) == [2.0, 3.0]
    assert src.read_grid(spark, path, end="2026-02-01").count() == 1 and src.read_grid(spark, path, start="2026-06-01").count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
def test_range_opens_its_months_only(spark):
    text = catalog.RUNS["stored_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    parts = next(line for line in text.splitlines() if "PartitionFilters" in line)
    assert "(month" in parts.split("PartitionFilters: [")[1].split("]")[0] and ">= 202402" in parts and "<= 202405" in parts
