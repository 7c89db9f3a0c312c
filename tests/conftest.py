import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusvitals.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def files(spark):
    """Build a files table from {path: content}."""

    def build(tree, repo="r"):
        rows = [(repo, p, len(c.encode()), c) for p, c in tree.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, size_bytes long, content string")

    return build
