import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    s = local_session("*", shuffle_partitions=8, app="quarry-tests")
    yield s
    s.stop()


@pytest.fixture
def one_row(spark):
    """Evaluate column expressions against literal rows: ``one_row(rows, schema, *cols)``."""

    def _eval(rows, schema, *cols):
        return spark.createDataFrame(rows, schema).select(*cols).collect()

    return _eval
