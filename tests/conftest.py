import os

import pytest

from corvine import session

SF = os.environ.get("CORVINE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
