import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from fleetscore.session import get_session

    session = get_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": os.path.join("/tmp", f"fleetscore-wh-{os.getpid()}"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted dicts of the named columns."""
    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((r.asDict() for r in chosen.collect()), key=repr)
    return collect


@pytest.fixture
def make(spark):
    """A bronze table from partial rows; columns left out are null."""
    from fleetscore.schemas import BRONZE

    def build(name, *partial):
        schema = spark.createDataFrame([], BRONZE[name]).schema
        return spark.createDataFrame([tuple(p.get(f.name) for f in schema) for p in partial], schema)
    return build
