import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = os.environ.get("STRAINWEAVE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strainweave.session import local_session

    s = local_session("tests", cpus=4, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
