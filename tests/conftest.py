from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from innsight.session import local_session

    scratch = tempfile.mkdtemp(prefix="innsight-tests-")
    session = local_session(
        cores="*",
        shuffle_partitions=8,
        app_name="innsight-tests",
        extra_conf={
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
            "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
        },
    )
    yield session
    session.stop()


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)
