import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.schema import Catalog  # noqa: E402
from tablewright.session import build_session  # noqa: E402
from tablewright.workspace import Workspace  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class FrameStore:
    """Tables held as frames, for small fixtures."""

    def __init__(self, frames):
        self.frames = frames

    def read(self, name, schema=None):
        return self.frames[name]

    def exists(self, name):
        return name in self.frames


@pytest.fixture
def small(spark):
    """A workspace over small tables: `small({spec: rows})`."""

    def build(tables):
        frames = {}
        for spec, rows in tables.items():
            schema = spec.struct(physical=True)
            for f in schema:
                f.nullable = True
            frames[spec.name] = spark.createDataFrame(rows, schema)
        return Workspace(spark, Catalog(*tables), FrameStore(frames))

    return build


def rows(df):
    """Rows as sorted tuples, NULLs last."""
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
