"""The driver's contract."""
import __spark_entry__ as entry
from statweave.operators.run import RUNNERS


def test_every_oracle_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 200


def test_every_test_id_runs():
    ids = {"T-101", "T-102", "T-103", "T-104", "T-105", "T-111", "T-112", "T-113", "T-121", "T-122", "T-123", "T-124", "T-131", "T-132", "T-133", "T-201", "T-202",
           "T-203", "T-211", "T-212", "T-221", "T-301", "T-302", "T-303", "T-304", "T-305", "T-311", "T-321", "T-401", "T-402", "T-403", "T-404", "T-501", "T-502",
           "T-503", "T-504", "T-601", "T-602", "T-603", "T-604", "T-605", "T-701", "T-702", "T-703", "T-704", "T-801", "T-802", "T-803", "T-804", "T-805", "T-806",
           "T-807", "T-901", "T-902", "T-903", "T-904", "T-1001", "T-1002", "T-1003", "T-1004", "T-1005", "T-1006", "T-1101", "T-1102", "T-1103", "T-1104"}
    assert ids == set(RUNNERS)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["stratum"] for r in rows} == {"overall", "F", "O"}
