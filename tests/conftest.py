import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegraph.core import session  # noqa: E402

F1 = [3, 1, 2, 4, 1, 3, 2, 5]


@pytest.fixture(scope="session")
def spark():
    s = session("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    def build(**series):
        rows = [(k, t, float(v)) for k, xs in series.items() for t, v in enumerate(xs)]
        return spark.createDataFrame(rows, "series_id string, t long, x double")

    return build


@pytest.fixture(scope="session")
def graph(spark):
    def build(**graphs):
        """name -> (number of nodes, edges)"""
        n = [(k, i) for k, (size, _) in graphs.items() for i in range(size)]
        e = [(k, min(a, b), max(a, b)) for k, (_, edges) in graphs.items() for a, b in edges]
        return (
            spark.createDataFrame(n, "series_id string, node long"),
            spark.createDataFrame(e, "series_id string, src long, dst long"),
        )

    return build
