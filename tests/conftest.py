import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapelake.session import SLICES_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "sliced"])
def group_limit(spark, request):
    """Run a test twice: with the slices that Spark chooses, and with slices of a few rows."""
    if request.param == "sliced":
        spark.conf.set(SLICES_KEY, "17")
    yield request.param
    spark.conf.unset(SLICES_KEY)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
