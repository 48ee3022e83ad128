"""First places of words without a sort of all occurrences."""

import pytest

from palaver.operators import ranking as rk
from palaver.plans import catalog

LEAST = -2**63
ROWS = [("a", LEAST, 3), ("a", LEAST, 2**31 - 1), ("b", None, 7), ("b", LEAST, 0), ("c", 2**63 - 1, 2**31 - 1), ("d", -1, 5), ("d", 0, 0),
        ("e", None, 0), ("f", -1, 2**31 - 1), ("f", -1, 2**31 - 2), ("g", 0, 0), ("h", -5, 0), ("i", 12345678901234, 17)]


@pytest.mark.parametrize("low,high,packed", [(LEAST, 2**63 - 1, "decimal"), (-5, 2**32 - 8, "bigint"), (2**63 - 2**32 + 2, 2**63 - 1, "bigint"), (-5, 2**32 - 7, "decimal")])
def test_smallest_pairs(spark, low, high, packed):
    rows = [(k, {LEAST: low, 2**63 - 1: high}.get(d, d), p) for k, d, p in ROWS]
    rows = [r for r in rows if r[1] is None or low <= r[1] <= high]
    df = spark.createDataFrame(rows, "k string, d bigint, p int")
    out = rk.first_places(df, "k", "d", "p", (low, high))
    got = {r["k"]: (r["d"], r["p"]) for r in out.collect()}
    want = {k: min(((d is not None, d or 0, p), (d, p)) for key, d, p in rows if key == k)[1] for k, _, _ in rows}
    assert got == want and ("decimal(38,0)" in out._jdf.queryExecution().optimizedPlan().toString()) == (packed == "decimal")
    assert {r["k"]: (r["d"], r["p"]) for r in rk.first_places(df, "k", "d", "p").collect()} == want


def test_occurrences_are_not_sorted(spark):
    """Words are brought to their first place in hash maps, and only then normalised and shuffled by term."""
    plan = catalog.QUERIES["agg13_keep_lowest_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("posexplode") - 2000:plan.index("posexplode")]
    assert "HashAggregate(keys=[word" in below and "regexp_replace" not in plan[plan.index("posexplode"):]
