import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from usagelens.schema import INTERACTIONS  # noqa: E402
from usagelens.session import build_session, clear_scratch  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("usagelens-tests", "local[4]", **{
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def many_slices(spark):
    """Without adaptive merging of partitions, small groups span several slices too."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def log(spark):
    def make(*rows):
        return spark.createDataFrame([(u, i, b, None if h is None else float(h)) for u, i, b, h in rows], INTERACTIONS)
    return make


@pytest.fixture
def texts(spark):
    def make(*values, name="text"):
        return spark.createDataFrame([(v,) for v in values], f"{name} string")
    return make


def column(df, name=None):
    return [row[name or 0] for row in df.collect()]


def by_key(df, key="item"):
    return {row[key]: row for row in df.collect()}
