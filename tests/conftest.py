import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stratus.session import checkpoint_dir, local_session

    os.environ.setdefault("STRATUS_DRIVER_MEMORY", "4g")
    s = local_session(cores=4, shuffle_partitions=4, app="stratus-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="stratus-test-")
