"""Links' signals and likely links against plain counting, and what they shuffle."""

import itertools
import math
import random

import pytest

from graphloom.operators import insights as I
from graphloom.operators import links as L
from graphloom.operators import relevance as R


def web(n, m, seed=3):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((int(n * rng.random() ** 2), rng.randrange(n)) for _ in range(m)) if a != b})


def adjacency(links):
    nbr = {}
    for a, b in links:
        nbr.setdefault(a, set()).add(b)
        nbr.setdefault(b, set()).add(a)
    return nbr


def shuffled(spark, work):
    """Rows that work writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = rows()
    work()
    return rows() - before


def test_signals_of_links_match_pair_by_pair(spark):
    links = spark.createDataFrame(web(40, 260), "src long, dst long")
    rng = random.Random(5)
    sources = spark.createDataFrame([(rng.randrange(40), rng.randrange(6)) for _ in range(80)], "id long, source long")
    pairs = L.undirected(links)
    as_rows = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.select("a", "b", "ways", "aa", "cn", "cited", "shared").collect())
    assert as_rows(R.link_signals(links, sources)) == as_rows(R.pair_signals(pairs, links, sources))


def test_pages_without_common_neighbours_cost_no_paths(spark):
    # all paths of two links between two sets of pages stay open: there are 2 * 30 * 435 of them
    links = spark.createDataFrame([(a, 100 + b) for a, b in itertools.product(range(30), repeat=2)], "src long, dst long")
    nbr = L.neighbours(links).localCheckpoint()
    assert shuffled(spark, lambda: R.linked_neighbours(nbr).collect()) < 10_000
    assert R.linked_neighbours(nbr).isEmpty()


@pytest.mark.parametrize("hub", [4, 64])
def test_likely_links_by_hand(spark, hub):
    links = web(40, 130)
    nbr = adjacency(links)
    pool = {(a, b) for mine in nbr.values() for a, b in itertools.combinations(sorted(mine)[:hub], 2) if b not in nbr[a]}
    want = {(a, b): (len(nbr[a] & nbr[b]), max(len(nbr[z]) for z in nbr[a] & nbr[b]), sum(1 / math.log(max(2, len(nbr[z]))) for z in nbr[a] & nbr[b])) for a, b in pool}
    table = L.neighbours(spark.createDataFrame(links, "src long, dst long"))
    pages = spark.createDataFrame([(i, i % 3) for i in nbr], "id long, community long")
    found = {(r.a, r.b): r for r in I.predictions(table, hub=hub, pages=pages).collect()}
    assert found.keys() == want.keys()
    for (a, b), r in found.items():
        assert (r.cn, r.hub, r.left, r.right) == (*want[a, b][:2], a % 3, b % 3) and r.aa == pytest.approx(want[a, b][2])
    assert {(r.a, r.b) for r in I.two_hops(table, hub=hub).collect()} == want.keys()
    some = {i for i in nbr if i % 2}
    assert {(r.a, r.b) for r in I.two_hops(table, hub=hub, among=pages.where("id % 2 = 1")).collect()} == {p for p in want if some.issuperset(p)}


def test_likely_links_shuffle_lists_and_not_pairs(spark):
    links = web(60, 900)
    nbr = L.neighbours(spark.createDataFrame(links, "src long, dst long")).localCheckpoint()
    paths = sum(len(x) * (len(x) - 1) // 2 for x in adjacency(links).values())
    assert shuffled(spark, lambda: I.predictions(nbr).collect()) < paths
