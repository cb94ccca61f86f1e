from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables are tiny here, so compiling plans would take longer than running them.
    session = local_session(4, shuffle_partitions=2, spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN")
    yield session
    session.stop()
