import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scanloom import sources
from scanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g")
    sources.register(session)
    yield session
    session.stop()
