import pytest

from tallyforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, "3g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
