import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shardlens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="shardlens-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def one(spark):
    """Evaluate one column expression over a one-row literal frame."""
    def run(expr, data, schema):
        return spark.createDataFrame([data], schema).select(expr.alias("x")).first()["x"]
    return run
