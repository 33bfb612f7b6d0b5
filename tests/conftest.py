import pytest

from quern.session import builder


@pytest.fixture(scope="session")
def spark():
    session = builder("tests", spark__master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
