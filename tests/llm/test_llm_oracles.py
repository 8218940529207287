import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from compare import compare, views  # noqa: E402

from millrace.llm import queries  # noqa: E402

FOLDER = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    said = compare(spark, views(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert said.startswith(("ok", "rows")), said
