"""Every core query against its SQL, over the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from compare import compare, views  # noqa: E402

from millrace.plans import catalog  # noqa: E402

FOLDER = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return views(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert said.startswith(("ok", "rows")), said


def test_queries_without_sql_are_known():
    # sequential packing, public tokenizers and a tree of hashes; each is tested against something else
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"pack_greedy", "pack_best_fit", "pack_structure", "pack_long_context", "compare_policies", "bpe_encode", "fertility_by_lang", "pretokens", "merkle_root"}
