"""Names resolve without a table sent to every task."""

from graphloom.operators import links as L


def test_no_side_of_a_resolution_is_broadcast(spark):
    refs = spark.createDataFrame([("a", "B"), ("a", "c d")], "id string, target string")
    keys = spark.createDataFrame([("b", "x"), ("c-d", "y")], "key string, id string")
    found = L.resolve_in_two(refs, keys.limit(1), keys)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", "B", "x", True), ("a", "c d", "y", False)]
