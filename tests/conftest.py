import pytest

from tidewater.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=2, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
