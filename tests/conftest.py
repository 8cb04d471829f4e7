import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from fleetlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "tests", spark__checkpoint__dir=shared, spark__sql__shuffle__partitions="2")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a DataFrame as tuples."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted(map(tuple, picked.collect()), key=lambda r: tuple((v is not None, v) for v in r))

    return collect
