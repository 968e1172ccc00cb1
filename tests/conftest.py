import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from clickweave.config import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def catalog(spark):
    from clickweave.plans.registry import catalog_for

    return catalog_for(spark, SF_SMALL)
