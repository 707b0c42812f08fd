"""Paths: distances, shortest subgraphs, bounded simple paths, route counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.iterate import cut
from graphloom.operators.filters import Filters, edges_between, visible_nodes
from graphloom.operators.links import neighbours

#: Routes are counted up to here.
MOST_ROUTES = 1_000_000


@dataclass(frozen=True)
class Paths:
    distance: int
    span: int
    nodes: DataFrame
    edges: DataFrame
    routes: int
    complete: bool = True


def hop_distances(nbr: DataFrame, start: object, most: int | None = None) -> DataFrame:
    """id, d of every page that start (d = 0) reaches, within most hops."""
    spark, kind = nbr.sparkSession, nbr.schema["id"].dataType
    seen = spark.createDataFrame([(start,)], "id " + kind.simpleString()).withColumn("d", F.lit(0).cast("long"))
    front, d = seen, 0
    while most is None or d < most:
        d += 1
        after = front.select("id").join(nbr, "id").select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("d", F.lit(d).cast("long"))
        front = cut(after)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_subgraph(nbr: DataFrame, source: object, target: object) -> tuple[DataFrame, DataFrame, int | None]:
    """Nodes (id, d) and edges (a, b) on any shortest path, and its length, None if there is none."""
    there = hop_distances(nbr, source)
    found = there.where(F.col("id") == target).first()
    back = hop_distances(nbr, target, None if found is None else found.d)
    return (*_on_shortest(nbr, there, back, -1 if found is None else found.d), None if found is None else found.d)


def _on_shortest(nbr: DataFrame, there: DataFrame, back: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    both = there.join(back.withColumnRenamed("d", "e"), "id")
    nodes = both.where(F.col("d") + F.col("e") == d).select("id", "d")
    steps = nbr.join(nodes.select("id", F.col("d").alias("at")), "id").join(nodes.select(F.col("id").alias("nbr"), F.col("d").alias("to")), "nbr").where("to = at + 1")
    return nodes, steps.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


#: Steps that an enumeration of simple paths may take, over all its rounds.
MOST_STEPS = 200_000


def simple_paths(nbr: DataFrame, source: object, target: object, most: int, *, back: DataFrame | None = None, steps: int | None = None) -> DataFrame | None:
    """path: every simple path of at most most hops, as an array; steps that can't reach the target in time aren't taken.

    With steps, None if more of them than that would be needed: a round takes one step
    more than is left at most, so a dense graph ends early.  back (id, d) may be given, the distances to target.
    """
    back = hop_distances(nbr, target, most) if back is None else back
    live = back.where(F.col("id") == source).select("id", F.array("id").alias("path"))
    done = live.where(F.col("id") == target).select("path")
    live = live.where(F.col("id") != target)
    left = steps
    for used in range(1, most + 1):
        step = live.join(nbr, "id").where(~F.array_contains("path", F.col("nbr"))).join(back.withColumnRenamed("id", "nbr"), "nbr").where(F.col("d") <= most - used)
        step = step.select(F.col("nbr").alias("id"), F.array_append("path", F.col("nbr")).alias("path"))
        live = cut(step if left is None else step.limit(left + 1))
        if left is not None:
            left -= live.count()
            if left < 0:
                return None
        done = done.unionByName(live.where(F.col("id") == target).select("path"))
        live = live.where(F.col("id") != target)
    return done


def within_span(nbr: DataFrame, there: DataFrame, back: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Pages (id, d) and edges (a, b) that some walk of at most span hops between two pages meets; more than those on simple paths."""
    both = there.join(back.withColumnRenamed("d", "e"), "id").where(F.col("d") + F.col("e") <= span)
    near = nbr.join(there, "id").join(back.select(F.col("id").alias("nbr"), F.col("d").alias("e")), "nbr").where(F.col("d") + 1 + F.col("e") <= span)
    return both.select("id", "d"), near.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def route_count(nodes: DataFrame, edges: DataFrame, source: object, target: object, d: int) -> int:
    """The number of shortest paths, layer by layer, up to MOST_ROUTES."""
    if d == 0:
        return 1
    step = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    down = step.join(nodes.select(F.col("id").alias("a"), F.col("d").alias("from")), "a").join(nodes.select(F.col("id").alias("b"), F.col("d").alias("to")), "b").where("to = from + 1")
    ways = nodes.where(F.col("id") == source).select("id", F.lit(1).cast("long").alias("n"))
    for _ in range(d):
        ways = down.join(ways.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.least(F.sum("n"), F.lit(MOST_ROUTES)).alias("n"))
    found = ways.where(F.col("id") == target).first()
    return int(found.n) if found else 0


def connecting_paths(nodes: DataFrame, nbr: DataFrame, source: object, target: object, *, max_distance: int | None = None, max_hops: int | None = None, steps: int = MOST_STEPS) -> Paths | None:
    """What connects two pages, or None if unknown, apart, or farther than max_distance.

    With max_hops beyond the distance, all simple paths of at most so many hops count;
    if they take more steps than that, all that walks of so many hops meet, and the answer isn't complete.
    """
    if nodes.where(F.col("id").isin(source, target)).select("id").distinct().count() < (1 if source == target else 2):
        return None
    there = hop_distances(nbr, source)
    found = there.where(F.col("id") == target).first()
    if found is None or max_distance is not None and found.d > max_distance:
        return None
    span = max(found.d, round(max_hops)) if max_hops is not None else found.d
    back = hop_distances(nbr, target, span)
    on, edges = _on_shortest(nbr, there, back, found.d)
    routes = route_count(on, edges, source, target, found.d)
    complete = True
    if span > found.d and source != target:
        every = simple_paths(nbr, source, target, span, back=back, steps=steps)
        if every is None:
            complete = False
            on, edges = within_span(nbr, there, back, span)
        else:
            every = cut(every)
            on = every.select(F.explode("path").alias("id")).distinct().join(there, "id")
            hops = every.select(F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("x"), F.slice("path", F.lit(2), F.size("path")).alias("y"))).alias("s"))
            edges = hops.select(F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).distinct()
    return Paths(found.d, span, on.orderBy("d", "id"), edges.orderBy("a", "b"), routes, complete)


def visible_paths(nodes: DataFrame, edges: DataFrame, filters: Filters, source: object, target: object, *, between: int | None = None, steps: int = MOST_STEPS) -> Paths | None:
    """connecting_paths in what filters leave of a graph, with at most so many pages between the two ends."""
    shown = cut(visible_nodes(nodes, filters))
    nbr = cut(neighbours(edges_between(edges, shown).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return connecting_paths(shown, nbr, source, target, max_hops=None if between is None else between + 1, steps=steps)


def neighbourhood(edges: DataFrame, node_id: object) -> tuple[DataFrame, DataFrame]:
    """The pages around one, itself among them (id), and the edges at it."""
    at = edges.where((F.col("a") == node_id) | (F.col("b") == node_id))
    own = edges.sparkSession.createDataFrame([(node_id,)], "id " + edges.schema["a"].dataType.simpleString())
    return at.select(F.explode(F.array("a", "b")).alias("id")).unionByName(own).distinct(), at


def focus(nodes: DataFrame, edges: DataFrame, nbr: DataFrame, ids: list) -> tuple[str, DataFrame | None, DataFrame | None]:
    """What to show for none, one, or two chosen pages: cleared, neighbourhood, connection or unreachable."""
    if not ids:
        return "cleared", None, None
    if len(ids) == 1:
        return "neighbourhood", *neighbourhood(edges, ids[0])
    found = connecting_paths(nodes, nbr, *ids[-2:])
    return ("connection", found.nodes, found.edges) if found else ("unreachable", None, None)


def focus_edges(nodes: DataFrame, edges: DataFrame, nbr: DataFrame, ids: list) -> DataFrame:
    """The edges between several chosen pages: those of all pairs' paths; at a single page, its own."""
    if len(ids) == 1:
        return neighbourhood(edges, ids[0])[1].select("a", "b")
    out = edges.select("a", "b").where("false")
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if found := connecting_paths(nodes, nbr, x, y):
                out = out.unionByName(found.edges)
    return out.distinct()
