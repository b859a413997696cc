import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chainlens.session import get_session
    scratch = tempfile.mkdtemp(prefix="chainlens-test-")
    s = get_session("local[4]", 8, extra={
        "spark.checkpoint.dir": f"{scratch}/ckpt",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.driver.memory": "4g",
    })
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="chainlens-t-")
