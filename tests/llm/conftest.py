import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """A folder of this test run, as a cluster would name one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="graphlens-tests-"))
