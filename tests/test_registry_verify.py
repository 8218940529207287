import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import verify  # noqa: E402

from millrace.functions import registry  # noqa: E402


def test_functions_by_name(spark):
    registry.register(spark)
    assert spark.sql("select normalize_nfc('é') x").first()["x"] == "é"
    got = spark.sql("select * from split_at_boundaries(10, array(7, 3), 4)").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3), (1, 3, 4), (2, 7, 3)]
    assert spark.sql("select * from split_at_boundaries(null, array(1), 4)").count() == 0


def test_policies_by_name(spark):
    items = spark.createDataFrame([(1, "a", 5, [2], 0, False), (2, "a", 9, [4, 8], 0, False)], "doc_id long, lane string, size int, points array<int>, min_context int, reserved boolean")
    for name, pack in registry.POLICIES.items():
        assert pack(items, 8).count() >= 1, name


def test_a_table_that_was_altered_is_noticed():
    rows = [{"check": "a", "bad": 0, "passed": True}, {"check": "b|c", "bad": 2, "passed": False}]
    table = verify.markdown(rows)
    assert verify.agrees(table, rows) and not verify.agrees(table.replace("| 2 |", "| 0 |"), rows) and not verify.agrees(table, rows[:1])
    assert verify.markdown([]) == ""


def test_verifier_runs_over_the_smallest_tables(monkeypatch, spark, capsys):
    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    monkeypatch.setattr(verify, "local_session", lambda n: spark)
    assert verify.main("/root/testdata/sf0.001", ["packing", "firewall"]) == 0
    assert verify.main("/root/testdata/sf0.001", ["no_such_check"]) == 1
    assert "## evidence" in capsys.readouterr().out
