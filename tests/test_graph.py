"""Small graphs whose answers are known."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import communities as C
from graphloom.operators import insights as I
from graphloom.operators import links as L
from graphloom.operators import paths as P
from graphloom.operators import relevance as R
from graphloom.operators import structure as G


def graph(spark, text, alone=()):
    """Nodes and links of an edge list such as 'a-b b-c'."""
    pairs = [tuple(x.split("-")) for x in text.split()]
    ids = sorted({i for p in pairs for i in p} | set(alone))
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_adjacency_drops_loops_and_repeats(spark):
    _, links = graph(spark, "a-b b-a a-a b-c")
    assert rows(L.neighbours(links), "id", "nbr") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_signals_by_hand(spark):
    _, links = graph(spark, "a-b b-a a-c b-c d-a d-b")
    sources = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "t")], "id string, source string")
    r = R.edge_scores(links, sources).where("a = 'a' AND b = 'b'").first()
    aa = 2 / __import__("math").log(2)
    assert r.direct_link == 4.0 and r.source_overlap == 1.0
    assert r.adamic_adar == pytest.approx(2 * aa / (1 + aa)) and r.co_citation == 0.5


def test_related_of_unknown_is_empty(spark):
    _, links = graph(spark, "a-b")
    none = spark.createDataFrame([], "id string, source string")
    assert R.related(links, none, "zz").count() == 0
    assert R.related(links, none, "a", 0).count() == 0


def test_shortest_and_simple_paths(spark):
    nodes, links = graph(spark, "s-a s-b a-t b-t a-x s-y y-z z-t", ["lonely"])
    nbr = L.neighbours(links)
    found = P.connecting_paths(nodes, nbr, "s", "t")
    assert found.distance == 2 and found.routes == 2
    assert {r.id for r in found.nodes.collect()} == {"s", "a", "b", "t"}
    more = P.connecting_paths(nodes, nbr, "s", "t", max_hops=3)
    assert {r.id for r in more.nodes.collect()} == {"s", "a", "b", "t", "y", "z"}  # x is a dead end
    assert P.connecting_paths(nodes, nbr, "s", "lonely") is None
    assert P.connecting_paths(nodes, nbr, "s", "t", max_distance=1) is None


def test_components_cuts_and_cores_against_brute_force(spark):
    rng = random.Random(3)
    ids = list(range(24))
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(26)})
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame(pairs, "a long, b long")

    def parts(keep, use):
        left, out = set(keep), []
        while left:
            todo, seen = [min(left)], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [b if a == x else a for a, b in use if x in (a, b) and a in keep and b in keep]
            out.append(seen)
            left -= seen
        return out

    whole = parts(set(ids), pairs)
    assert dict(rows(G.components(nodes, edges), "id", "component")) == {i: min(p) for p in whole for i in p}
    found = G.cut_analysis(nodes, edges)
    cuts = {i for i in ids if len(parts(set(ids) - {i}, pairs)) > len(whole) - (0 if any(i in p for p in pairs) else 1)}
    assert {r.a for r in found.where("kind = 'cut'").collect()} == cuts
    bridges = {p for p in pairs if len(parts(set(ids), [q for q in pairs if q != p])) > len(whole)}
    assert set(rows(found.where("kind = 'bridge'"), "a", "b")) == bridges
    core = {}
    left, use = set(ids), list(pairs)
    k = 0
    while left:
        deg = {i: sum(i in p for p in use) for i in left}
        low = min(left, key=lambda i: (deg[i], i))
        k = max(k, deg[low])
        core[low] = k
        left.discard(low)
        use = [p for p in use if low not in p]
    got = dict(rows(G.core_numbers(L.neighbours(edges.toDF("src", "dst"))), "id", "core"))
    assert got == {i: c for i, c in core.items() if i in got} and all(core[i] == 0 for i in ids if i not in got)


def test_constraint_of_k4(spark):
    _, links = graph(spark, "a-b a-c a-d b-c b-d c-d")
    assert {round(r.constraint, 9) for r in G.constraint(L.neighbours(links)).collect()} == {3.0}


def test_louvain_finds_planted_groups(spark):
    cliques = [[f"{g}{k}" for k in range(5)] for g in "abcd"]
    pairs = [p for c in cliques for p in itertools.combinations(c, 2)] + [(cliques[i][0], cliques[(i + 1) % 4][1]) for i in range(4)]
    nodes = spark.createDataFrame([(i,) for c in cliques for i in c], "id string")
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "a string, b string, weight double")
    of = dict(rows(C.louvain(nodes, edges), "id", "community"))
    assert len(set(of.values())) == 4 and all(len({of[i] for i in c}) == 1 for c in cliques)
    assert set(dict(rows(C.louvain(nodes, edges.where("false")), "id", "community")).values()) == {0}


def test_remap_keeps_numbers(spark):
    new = spark.createDataFrame([(i, 0 if i < 4 else 1 if i < 6 else 2) for i in range(9)], "id long, c long")
    old = spark.createDataFrame([(i, 7 if i < 4 else 0) for i in range(6)], "id long, c long")
    assert C.remap(new, old) == {0: 7, 1: 0, 2: 1}


def test_missing_link_of_a_square_with_a_tail(spark):
    _, links = graph(spark, "a-c a-d b-c b-d d-e")
    found = I.missing_links(links, k=None)
    assert ("a", "b") in rows(found, "a", "b") and ("a", "c") not in rows(found, "a", "b")


def test_two_hops_cap_is_by_rank(spark):
    _, links = graph(spark, " ".join(f"hub-{k:02d}" for k in range(10)))
    assert I.two_hops(L.neighbours(links), hub=3).count() == 3


def test_gateway_needs_one_exit_page(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "id string, community long")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("c", "d")], "a string, b string")
    assert rows(G.gateways(nodes, edges), "community", "id", "exits") == [(1, "a", 2)]


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "id long")
    links = spark.createDataFrame([], "src long, dst long")
    assert L.neighbours(links).count() == 0
    assert G.components(nodes, L.undirected(links)).count() == 0
    assert G.core_numbers(L.neighbours(links)).select(F.count("*")).first()[0] == 0


def test_paths_of_a_dense_graph_end(spark):
    n = 9
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "id long")
    links = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)] + [(n, 0), (n + 1, n)], "src long, dst long")
    nbr = L.neighbours(links)
    whole = P.connecting_paths(nodes, nbr, 0, 8, max_hops=3)
    assert whole.complete and {r.id for r in whole.nodes.collect()} == set(range(n))
    short = P.connecting_paths(nodes, nbr, 0, 8, max_hops=4, steps=50)
    assert not short.complete and short.distance == 1
    # beyond the budget, pages off all simple paths may be there, but none is missing
    assert set(range(n)) <= {r.id for r in short.nodes.collect()} and n + 1 not in {r.id for r in short.nodes.collect()}
    assert P.simple_paths(nbr, 0, 8, 4, steps=50) is None and P.simple_paths(nbr, 0, 8, 2, steps=50).count() == 8


def test_paths_run_through_visible_pages_only(spark):
    from graphloom.operators.filters import Filters

    nodes = spark.createDataFrame([(i, "concept", "concept", [], 0, False, 2) for i in "abcde"] + [("x", "query", "query", [], 0, False, 2)], "id string, raw_type string, type string, tags array<string>, community int, is_structural boolean, vault_link_count long")
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "c"), ("c", "d"), ("b", "d"), ("a", "e")], "a string, b string")
    assert P.visible_paths(nodes, edges, Filters(), "a", "b").distance == 2
    hidden = P.visible_paths(nodes, edges, Filters(hidden_types=("query",)), "a", "b", between=2)
    assert hidden.distance == hidden.span == 3 and [r.id for r in hidden.nodes.collect()] == ["a", "c", "d", "b"]
    assert P.visible_paths(nodes, edges, Filters(hidden_types=("query",), hidden_communities=(0,)), "a", "b") is None
