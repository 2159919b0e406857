import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicloom.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        builder("tests")
        .master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """A corpus from (path, content) pairs."""

    def make(*pairs):
        return spark.createDataFrame(list(pairs), "path string, content string")

    return make


@pytest.fixture(scope="session")
def rows():
    """A frame as a set of tuples."""

    def collect(df, *columns):
        return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}

    return collect
