from __future__ import annotations

import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()
