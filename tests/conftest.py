import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from textlab.session import get_spark, release_scratch
    s = get_spark("local[4]", app="textlab-tests", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="textlab-test-ckpt-"),
    })
    yield s
    release_scratch(s)
    s.stop()
