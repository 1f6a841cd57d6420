import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from almanac.session import build_session
    ckpt = tempfile.mkdtemp(prefix="almanac-test-ckpt-")
    s = build_session("local[*]", conf={"spark.sql.shuffle.partitions": "8",
                                        "spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
