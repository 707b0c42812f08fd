"""How strongly two pages belong together: four signals and their sum."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import saturate
from graphloom.iterate import cut
from graphloom.operators.links import neighbours


@dataclass(frozen=True)
class Weights:
    direct: float = 4.0
    common: float = 2.0
    sources: float = 2.0
    cited: float = 1.0


def common_neighbours(pairs: DataFrame, nbr: DataFrame) -> DataFrame:
    """a, b, z for every neighbour z that a pair shares.

    Pairs are joined first, and start from the end with fewer neighbours, so that a
    hub's neighbours are never listed for each of its pairs with a small page.
    """
    deg = nbr.groupBy("id").agg(F.count("*").alias("n"))
    sized = pairs.select("a", "b").join(deg.toDF("a", "na"), "a").join(deg.toDF("b", "nb"), "b")
    small = F.col("na") <= F.col("nb")
    sized = sized.select("a", "b", F.when(small, F.col("a")).otherwise(F.col("b")).alias("near"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("far"))
    left = sized.join(nbr.select(F.col("id").alias("near"), F.col("nbr").alias("z")), "near")
    return left.join(nbr.select(F.col("id").alias("far"), F.col("nbr").alias("z")), ["far", "z"]).select("a", "b", "z")


def adamic_adar(pairs: DataFrame, nbr: DataFrame) -> DataFrame:
    """a, b, aa, ra, cn, hub: over shared neighbours z, sums of 1/ln d(z), 1/d(z) and 1, and the largest degree."""
    deg = nbr.groupBy("id").agg(F.greatest(F.count("*"), F.lit(2)).alias("d")).withColumnRenamed("id", "z")
    return common_neighbours(pairs, nbr).join(deg, "z").groupBy("a", "b").agg(F.sum(1 / F.ln("d")).alias("aa"), F.sum(1 / F.col("d")).alias("ra"), F.count("*").alias("cn"), F.max("d").alias("hub"))


def cocited(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, n: pages that link to both."""
    into = links.select(F.col("dst").alias("id"), F.col("src").alias("nbr")).distinct()
    return common_neighbours(pairs, into).groupBy("a", "b").agg(F.count("*").alias("n"))


def shared_sources(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """a, b, n, keys: sources (id, source) that both have."""
    has = sources.select("id", F.col("source").alias("nbr")).distinct()
    return common_neighbours(pairs, has).groupBy("a", "b").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("z")).alias("keys"))


def pair_signals(pairs: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """a, b, ways, aa, cn, cited, shared of pairs: half the links between them, what their shared neighbours give, how many there are, pages that cite both, and shared sources."""
    pairs = pairs.select("a", "b").distinct()
    direct = links.distinct().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg((F.count("*") / 2).alias("ways"))
    out = pairs.join(direct, ["a", "b"], "left").join(adamic_adar(pairs, neighbours(links)).select("a", "b", "aa", "cn"), ["a", "b"], "left")
    out = out.join(cocited(pairs, links).withColumnRenamed("n", "cited"), ["a", "b"], "left")
    return out.join(shared_sources(pairs, sources).select("a", "b", F.col("n").alias("shared")), ["a", "b"], "left").na.fill(0)


def _meetings(nbr: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every linked pair once, as u, v, du, dv, uv, with shared (sources) and w: the triangles in which u and v are the two least pages.

    nbr (id, nbr, and mark, if any) holds both ways of a link.  Pages are ordered by their number of
    neighbours and sources, so a page has few neighbours after it, hubs too.  What follows
    v in u's list goes to v, whose own list closes the triangles: a list travels as one row,
    and no path of two links is ever a row.  Marks of u on v, u on w and v on w are uv, uw and vw.
    Files of lists tell little of their size in memory: no side is broadcast.
    """
    if "mark" not in nbr.columns:
        nbr = nbr.select("id", "nbr", F.lit(0).cast("byte").alias("mark"))
    size = nbr.withColumn("d", F.count("*").over(Window.partitionBy("id")))
    pages = size.groupBy("id").agg(F.first("d").alias("d"))
    if sources is not None:
        kept = sources.groupBy("id").agg(F.collect_set("source").alias("items"))
        size = size.join(kept.select("id", F.size("items").alias("s")).hint("merge"), "id", "left")
        pages = pages.join(kept.hint("merge"), "id", "left")
    else:
        size, pages = size.withColumn("s", F.lit(0)), pages.withColumn("items", F.lit(None).cast("array<int>"))
    size = size.withColumn("n", F.col("d") + F.coalesce("s", F.lit(0)))
    own = pages.select("id", (F.col("d") + F.greatest(F.size("items"), F.lit(0))).alias("own"))
    swap = (F.shiftleft(F.col("mark").bitwiseAND(1), 1) + F.shiftright("mark", 1)).cast("byte")
    ends = size.select(F.col("nbr").alias("id"), "n", F.col("id").alias("to"), "d", swap.alias("mark")).join(own.hint("merge"), "id")
    after = ends.where((F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("to") > F.col("id"))))
    lists = after.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "to", "d", "mark"))).alias("after"))
    pages = cut(pages.join(lists.hint("merge"), "id", "left"))
    sent = pages.select("id", "d", "items", F.posexplode("after").alias("at", "x"), F.col("after.to").alias("to"), F.col("after.mark").alias("marks"))
    rest = lambda c: F.slice(c, F.col("at") + 2, F.greatest(F.size(c) - F.col("at") - 1, F.lit(0)))
    sent = sent.select(F.col("id").alias("u"), F.col("d").alias("du"), "items", F.col("x.to").alias("id"), F.col("x.mark").alias("uv"), rest("to").alias("to"), rest("marks").alias("marks"))
    met = sent.join(pages.select("id", F.col("d").alias("dv"), F.col("items").alias("theirs"), "after").hint("merge"), "id")
    shared = F.greatest(F.size(F.array_intersect("items", "theirs")), F.lit(0)) if sources is not None else F.lit(0)
    spot = lambda w: F.get("after", F.array_position("after.to", w).cast("int") - 1)
    closed = lambda w: F.struct(w.alias("id"), spot(w)["d"].alias("d"), F.get("marks", F.array_position("to", w).cast("int") - 1).alias("uw"), spot(w)["mark"].alias("vw"))
    third = F.coalesce(F.array_intersect("to", "after.to"), F.slice("to", 1, 0))
    return met.select("u", F.col("id").alias("v"), "du", "dv", "uv", shared.alias("shared"), F.transform(third, closed).alias("w"))


def _thirds(one: Callable) -> Column:
    """Of each triangle of a row of _meetings, what one makes of its three pairs: of both ends, the third page, its degree, and whether it links to each end."""
    u, v = F.col("u"), F.col("v")
    low, high = lambda m: m.bitwiseAND(1) != 0, lambda m: m.bitwiseAND(2) != 0  # noqa: E731  links from the first, and to it
    each = lambda w: F.array(
        one(u, v, w["id"], w["d"], high(w["uw"]) & high(w["vw"])), one(u, w["id"], v, F.col("dv"), high(F.col("uv")) & low(w["vw"])), one(v, w["id"], u, F.col("du"), low(F.col("uv")) & low(w["uw"])),
    )
    return F.flatten(F.transform("w", each))


def linked_neighbours(nbr: DataFrame) -> DataFrame:
    """a, b, z, d: for every linked pair a < b, each neighbour z that both share, and its degree."""
    one = lambda x, y, z, d, _: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), z.alias("z"), d.alias("d"))
    return _meetings(nbr.select("id", "nbr")).select(F.explode(_thirds(one)).alias("x")).select("x.*")


def linked_adar(nbr: DataFrame) -> DataFrame:
    """adamic_adar of all linked pairs."""
    d = F.greatest("d", F.lit(2))
    return linked_neighbours(nbr).groupBy("a", "b").agg(F.sum(1 / F.ln(d)).alias("aa"), F.sum(1 / d).alias("ra"), F.count("*").alias("cn"), F.max(d).alias("hub"))


def link_signals(links: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """pair_signals of all linked pairs, found together."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(1).alias("mark")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(2).alias("mark")))
    nbr = links.where("src <> dst").select(F.explode(ends).alias("x")).select("x.*").repartition("id").groupBy("id", "nbr").agg(F.bit_or("mark").cast("byte").alias("mark"))
    part = lambda x, y, ways, shared, aa, cn, cited: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), ways.cast("double").alias("ways"), shared.cast("long").alias("shared"), aa.cast("double").alias("aa"), cn.cast("long").alias("cn"), cited.cast("long").alias("cited"))
    no = F.lit(0)
    own = part(F.col("u"), F.col("v"), F.bit_count("uv") / 2, F.col("shared"), no, no, no)
    one = lambda x, y, z, d, cites: part(x, y, no, no, 1 / F.ln(F.greatest(d, F.lit(2))), F.lit(1), F.when(cites, 1).otherwise(0))
    found = _meetings(nbr, None if sources is None else sources.select("id", "source").distinct())
    rows = found.select(F.explode(F.concat(F.array(own), _thirds(one))).alias("x")).select("x.*")
    return rows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("ways", "aa", "cn", "cited", "shared")])


def relevance(pairs: DataFrame, links: DataFrame, sources: DataFrame, weights: Weights = Weights(), *, counts: bool = False) -> DataFrame:
    """a, b and direct_link, source_overlap, adamic_adar, co_citation, total of pairs a < b; with counts, shared (sources) and cn too."""
    return weighed(pair_signals(pairs, links, sources), weights, counts=counts)


def weighed(signals: DataFrame, weights: Weights = Weights(), *, counts: bool = False) -> DataFrame:
    """relevance of what pair_signals or link_signals gives."""
    zero = F.col("a") == F.col("b")
    part = lambda w, c: F.when(zero, 0.0).otherwise(w * c)
    out = signals.select(
        "a", "b", part(weights.direct, F.col("ways")).alias("direct_link"), part(weights.sources, saturate(F.col("shared"))).alias("source_overlap"), part(weights.common, saturate(F.col("aa"))).alias("adamic_adar"),
        part(weights.cited, saturate(F.col("cited"))).alias("co_citation"), *(["shared", "cn"] if counts else []),
    )
    return out.withColumn("total", F.col("direct_link") + F.col("source_overlap") + F.col("adamic_adar") + F.col("co_citation"))


def edge_scores(links: DataFrame, sources: DataFrame, weights: Weights = Weights(), *, counts: bool = False) -> DataFrame:
    """relevance of linked pairs."""
    return weighed(link_signals(links, sources), weights, counts=counts)


def candidates(links: DataFrame, sources: DataFrame, node_id: object) -> DataFrame:
    """a, b of every pair of a page with one that may be relevant to it: linked, two hops away, or sharing a source or a citing page."""
    nbr = neighbours(links)
    mine = nbr.where(F.col("id") == node_id).select(F.col("nbr").alias("z"))
    near = mine.select(F.col("z").alias("o"))
    two = mine.join(nbr.withColumnRenamed("id", "z"), "z").select(F.col("nbr").alias("o"))
    src = sources.where(F.col("id") == node_id).select("source").distinct().join(sources, "source").select(F.col("id").alias("o"))
    other = near.unionByName(two).unionByName(src).where(F.col("o") != node_id).distinct()
    me = F.lit(node_id)
    return other.select(F.least(me, "o").alias("a"), F.greatest(me, "o").alias("b"))


def related(links: DataFrame, sources: DataFrame, node_id: object, k: int = 5, weights: Weights = Weights()) -> DataFrame:
    """id, rank and signals of the k pages most relevant to one."""
    scored = relevance(candidates(links, sources, node_id), links, sources, weights).where("total > 0")
    out = scored.withColumn("id", F.when(F.col("a") == node_id, F.col("b")).otherwise(F.col("a"))).drop("a", "b")
    top = out.orderBy(F.desc("total"), "id").limit(max(0, k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "id")))  # of k rows


def incident(edges: DataFrame, k: int = 3) -> DataFrame:
    """id, nbr, weight, rank: the k heaviest edges (a, b, weight) of every page."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), "weight"), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), "weight"))).alias("x")).select("x.*")
    return ends.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "nbr"))).where(F.col("rank") <= k)


def normalised(edges: DataFrame) -> DataFrame:
    """edges with norm: weight over the largest weight, which counts as 1 at least."""
    most = edges.agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("__most"))
    return edges.crossJoin(F.broadcast(most)).withColumn("norm", F.col("weight") / F.col("__most")).drop("__most")  # one row
