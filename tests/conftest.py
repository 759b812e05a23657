from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tollgate.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        4,
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder)},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
