import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from innings_engine.session import build_session
    session = build_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def log(spark, sf):
    """Small delivery log, written once."""
    from innings_engine.plans.forecast import staged_log
    return staged_log(spark, sf)
