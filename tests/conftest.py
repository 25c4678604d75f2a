import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vidmart.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vidmart-test-ckpt-"),
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="vidmart-test-wh-")})
    yield s
    s.stop()
