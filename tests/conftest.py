import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from beaconlake.session import session

    s = session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
