import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check_queries import session, tables  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(shared=str(tmp_path_factory.mktemp("shared")))
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    return tables(sf_dir)


def one(spark, schema, values, *columns):
    """Values of column expressions over a small frame."""
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]
