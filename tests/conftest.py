import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from seatwise.workspace import run  # noqa: E402
from tests.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    with run(session()) as spark:
        yield spark
