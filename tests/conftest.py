import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from axleyard.session import session

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = session("local[4]", {"spark.local.dir": tmp, "spark.checkpoint.dir": f"{tmp}/checkpoint", "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
