import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from timesift.session import build_session, clear_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "timesift-tests")
    session.sparkContext.setLogLevel("ERROR")
    # Tables of a few rows: compiling code costs more than it saves.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    clear_tables(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Make a table from tuples and collect one as sorted tuples."""

    class Rows:
        @staticmethod
        def make(data, schema):
            return spark.createDataFrame(data, schema)

        @staticmethod
        def got(df, *columns):
            return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)

    return Rows
