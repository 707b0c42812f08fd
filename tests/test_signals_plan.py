"""Signals of links are found without a table sent to every task."""

from graphloom.operators import relevance as R
from tests.test_met import web


def test_no_list_of_neighbours_is_broadcast(spark):
    links = spark.createDataFrame(web(40, 130), "src long, dst long")
    sources = spark.createDataFrame([(k, k % 3) for k in range(40)], "id long, source long")
    plan = R.link_signals(links, sources)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
