import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradewell.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[2]",
        app_name="gradewell-tests",
        shuffle_partitions=4,
        extra={"spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "2"},
    )
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gw-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="gw-test-")
