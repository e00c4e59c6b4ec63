import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression over the fields of one row."""

    def evaluate(expression, schema="x int", row=(0,)):
        return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]

    return evaluate
