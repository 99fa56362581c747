import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from agriclime.session import local_session  # noqa: E402
from agriclime.sources.tables import remove_stage_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4,
        "4g",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    remove_stage_tables(session)
    session.stop()
