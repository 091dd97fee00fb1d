import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from wayside.session import local_session

    return local_session("*", "tests")


@pytest.fixture
def frame(spark):
    """Rows as dictionaries to a DataFrame spread over several partitions, in no particular order."""

    def make(schema: str, rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema).repartition(4)

    return make
