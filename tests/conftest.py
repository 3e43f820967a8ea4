import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

from pagelens.session import local_session, prepare  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    prepare(session)
    return session


@pytest.fixture(scope="session")
def tables(spark):
    from pagelens.plans.fixtures import Tables

    return Tables(spark, DATA)
