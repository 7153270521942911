import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from textguard.session import get_spark
    s = get_spark("textguard-tests", master="local[4]", shuffle_partitions=8, driver_memory="4g")
    yield s


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}
