import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from livepricing.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # tests run locally: saved tables go to a fresh scratch warehouse
    s = build_session("local[4]", shuffle_partitions=4,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lp-test-wh-")})
    # tests run locally: nothing configured, so give checkpoints a scratch folder
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lp-test-ckpt-"))
    yield s
    s.stop()
