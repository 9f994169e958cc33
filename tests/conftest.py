import pytest

from docengine.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/docengine-tests-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    return s
