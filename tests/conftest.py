from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from glyphmill.session import clear_work, local_session

    session = local_session(8, app="tests", memory="12g")
    yield session
    clear_work(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def kit(spark, sf_dir):
    from glyphmill.plans import inputs

    return inputs.kit(spark, sf_dir)
