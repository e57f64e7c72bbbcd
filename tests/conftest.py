import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from graphloom.session import local_session

    SparkSession.builder.config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
    session = local_session(4, 4, "2g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def at():
    def when(day: int, hour: int = 0) -> datetime:
        return datetime(2024, 1, day, hour)

    return when
