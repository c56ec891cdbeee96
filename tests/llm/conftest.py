import os

import pytest


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
