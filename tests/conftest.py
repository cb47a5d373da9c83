import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankflow.session import local_session
    s = local_session(4, shuffle_partitions=4, app="rankflow-tests")
    yield s
    s.stop()


# FIXTURES section 2: raw edge lines (tab shown as \t there).
EDGE_LINES = [
    "# FromNodeId ToNodeId",
    "1 2",
    "1\t2",
    "1 3",
    "2 3",
    "3 1",
    "3 3",
    "4 3 77",
    "5",
    "",
    " \t3  6",
]


@pytest.fixture()
def edge_lines(spark):
    return spark.createDataFrame([(x,) for x in EDGE_LINES], "value string")


@pytest.fixture()
def golden_edges(spark, edge_lines):
    from rankflow.sources.text import parse_edges
    return parse_edges(edge_lines)


def lines_df(spark, lines, job_id="j", algo="giraph"):
    return spark.createDataFrame(
        [(job_id, algo, i, v) for i, v in enumerate(lines)],
        "job_id string, algo string, pos bigint, value string")
