import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grid_helpers import START, at  # noqa: E402

from gridloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def series(spark):
    """series({id: [values]}) -> regular frame (series_id, ts, x); None stays null, `...` leaves the row out."""
    def make(data, start=START, minutes=15, name="x"):
        rows = [(sid, at(i, start, minutes), v) for sid, vs in data.items() for i, v in enumerate(vs) if v is not ...]
        return spark.createDataFrame(rows, f"series_id int, ts timestamp_ntz, {name} double")
    return make
