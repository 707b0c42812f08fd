"""Filters, facets, search and colours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import bare_id, type_key, type_label


@dataclass(frozen=True)
class Filters:
    hidden_types: tuple[str, ...] = ()
    hidden_communities: tuple[int, ...] = ()
    hidden_tags: tuple[str, ...] = ()
    included_tags: tuple[str, ...] | None = None
    hide_structural: bool = False
    hide_isolated: bool = False

    def column(self) -> Column:
        """Whether a node is visible."""
        keep = F.lit(True)
        if self.hidden_types:
            keep &= ~(type_key(F.col("raw_type"), F.col("type")).isin(*self.hidden_types) | F.col("type").isin(*self.hidden_types))
        if self.hidden_communities:
            keep &= ~F.col("community").isin(*self.hidden_communities)
        if self.hide_structural:
            keep &= ~F.col("is_structural")
        if self.hide_isolated:
            keep &= (F.col("vault_link_count") != 0) | F.col("is_structural")
        if self.hidden_tags:
            keep &= ~F.arrays_overlap("tags", F.array(*map(F.lit, self.hidden_tags)))
        if self.included_tags:
            keep &= F.arrays_overlap("tags", F.array(*map(F.lit, self.included_tags)))
        return keep


def visible_nodes(nodes: DataFrame, filters: Filters) -> DataFrame:
    return nodes.where(filters.column())


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")


def type_facet(nodes: DataFrame) -> DataFrame:
    """key, label, n: declared types, spelt as the first page by id spells them."""
    raw, kind = F.col("raw_type"), F.col("type")
    return nodes.select("id", type_key(raw, kind).alias("key"), type_label(raw, kind).alias("label")).groupBy("key").agg(F.min_by("label", "id").alias("label"), F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def tag_facet(nodes: DataFrame) -> DataFrame:
    """tag, n: pages with each tag."""
    return nodes.select(F.explode(F.array_distinct("tags")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, id, type or path hold every word of the query."""
    text = F.lower(F.concat_ws(" ", "label", F.col("id").cast("string"), "type", "path"))
    keep = F.lit(True)
    for word in query.lower().split():
        keep &= F.contains(text, F.lit(word))
    return nodes.where(keep)


def matching_tags(facet: DataFrame, part: str) -> DataFrame:
    return facet.where(F.contains(F.lower("tag"), F.lit(part.strip().lower()))) if part.strip() else facet


def foreign(rows: DataFrame, nodes: DataFrame, filters: Filters, folder: str = "") -> DataFrame:
    """Rows (path) of another graph that our filters leave: those of hidden nodes go, those of no node stay."""
    from graphloom.sources.vault import inside

    known = nodes.select("id", filters.column().alias("shown"))
    return rows.where(inside(F.col("path"), folder)).withColumn("id", bare_id(F.col("path"))).join(known, "id", "left").where("shown IS NULL OR shown").drop("shown", "id")


def resolve_foreign(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (path) with node: the node of that id, else the first of that file name."""
    r = rows.withColumn("fid", bare_id(F.col("path"))).withColumn("name", F.substring_index("fid", "/", -1))
    names = nodes.groupBy(F.substring_index("id", "/", -1).alias("name")).agg(F.min("id").alias("by_name"))
    return r.join(nodes.select(F.col("id").alias("fid"), F.col("id").alias("by_id")), "fid", "left").join(names, "name", "left").select("path", F.coalesce("by_id", "by_name").alias("node"))


def drawn_types(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    """key, n, drawn: each type's pages, and those that are drawn."""
    return type_facet(nodes).select("key", "n").join(type_facet(drawn).select("key", F.col("n").alias("drawn")), "key", "left").na.fill(0)


def type_colours(types: DataFrame, stored: DataFrame, ramp: int = 22) -> DataFrame:
    """key, slot: the stored slot (key, slot) of each type in use, first come by key; others take free slots in order, then share."""
    kept = stored.join(types.select("key").distinct(), "key", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("slot").orderBy("key"))).where("n = 1").select("key", "slot")
    free = types.sparkSession.range(ramp).select(F.col("id").cast("int").alias("slot")).join(kept, "slot", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("slot")))  # of ramp rows
    rest = types.select("key").distinct().join(kept, "key", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("key")))  # of types
    late = rest.join(free, "k", "left").select("key", F.coalesce("slot", F.pmod(F.col("k") - 1, F.lit(ramp)).cast("int")).alias("slot"))
    return kept.unionByName(late)


def edge_style(edges: DataFrame) -> DataFrame:
    """edges (norm) with width, alpha and a mix of two greys as a colour."""
    part = lambda lo, hi: F.lpad(F.lower(F.hex(F.round(lo + (hi - lo) * F.col("norm")).cast("long"))), 2, "0")
    return edges.withColumn("width", 0.5 + 2.5 * F.col("norm")).withColumn("alpha", 0.15 + 0.65 * F.col("norm")).withColumn("colour", F.concat(F.lit("#"), part(0xCC, 0x33), part(0xCC, 0x44), part(0xCC, 0x66)))


def node_size(nodes: DataFrame, least: float = 3.0, span: float = 12.0) -> DataFrame:
    """nodes (link_count) with size, by the root of their share of the most links."""
    most = nodes.agg(F.greatest(F.max("link_count"), F.lit(1)).alias("most"))
    return nodes.crossJoin(F.broadcast(most)).withColumn("size", least + span * F.sqrt(F.col("link_count") / F.col("most"))).drop("most")  # one row


def community_colour(community: Column, colours: int = 12) -> Column:
    """The slot of a community's colour; -1 for none."""
    return F.when(community >= 0, F.pmod(community, F.lit(colours))).otherwise(-1)


def name_slot(name: Column, slots: int = 22) -> Column:
    """A slot that a name alone decides: its characters as digits to the base 31, modulo 2^32 and slots."""
    digits = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(digits, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32)) % slots).cast("int")


def node_colour(nodes: DataFrame, mode: str, *, custom: str = "", types: DataFrame | None = None, type_overrides: dict[str, str] | None = None, community_overrides: dict[int, str] | None = None, slots: int = 22) -> DataFrame:
    """nodes (type, community) with colour, by mode: custom, community or type.

    A choice of the reader's own goes first, but only in the mode that it belongs to;
    an empty one is none.  Then comes the slot of the community, or that which types
    (key, slot) assigns to the type, or one that the type's name decides.
    """
    chosen = lambda given, c: F.nullif(F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), c), F.lit("")) if given else F.lit(None).cast("string")
    if mode == "custom":
        return nodes.withColumn("colour", F.lit(custom))
    if mode == "community":
        return nodes.withColumn("colour", F.coalesce(chosen(community_overrides, F.col("community")), F.concat(F.lit("community "), community_colour(F.col("community")).cast("string"))))
    slot = name_slot(F.col("type"), slots)
    if types is not None:
        nodes = nodes.join(types.select(F.col("key").alias("type"), F.col("slot").alias("__slot")), "type", "left")
        slot = F.coalesce("__slot", slot)
    return nodes.withColumn("colour", F.coalesce(chosen(type_overrides, F.col("type")), F.concat(F.lit("type "), slot.cast("string")))).drop("__slot")


# Sizes of graphs above which less is drawn, and what for each: rounds of a layout, density and least size of labels, and whether edges and labels go while the view moves.
TUNING = [(2500, 28, 0.08, 18, True, True), (1500, 40, 0.14, 14, True, True), (1200, 40, 0.14, 14, True, False), (600, 65, 0.24, 10, True, False), (250, 90, 0.4, 4, False, False), (-1, 140, 0.4, 4, False, False)]


def tuning(nodes: Column) -> Column:
    """What a graph of so many nodes can afford to draw: iterations, density, threshold, hide_edges, hide_labels."""
    names = ("iterations", "density", "threshold", "hide_edges", "hide_labels")
    rows = [(above, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)])) for above, *row in TUNING]
    out = rows[-1][1]
    for above, row in reversed(rows[:-1]):
        out = F.when(nodes > above, row).otherwise(out)
    return out


def layout_key(nodes: DataFrame, edges: DataFrame, gravity: float = 1.0) -> DataFrame:
    """One row, key: the same for the same pages, edges and weights to a thousandth.

    Sums of hashes, not a sorted list of all of them: no task sees the whole graph.
    """
    n = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 31))), F.lit(0)).alias("hn"))
    e = edges.agg(F.count("*").alias("e"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b", F.round(F.col("weight") * 1000).cast("long")), F.lit(1 << 31))), F.lit(0)).alias("he"))
    return n.crossJoin(e).select(F.sha2(F.concat_ws(":", "n", "hn", "e", "he", F.lit(gravity)), 256).alias("key"))  # one row each


def adopt_layout(nodes: DataFrame, nbr: DataFrame, known: DataFrame) -> DataFrame:
    """id, x, y: known positions, then the middle of placed neighbours with a fixed jitter, the rest on a golden-angle spiral."""
    import math

    from graphloom.iterate import cut

    placed = cut(known.join(nodes.select("id"), "id", "left_semi").select("id", "x", "y"))
    jitter = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0 - 0.5) * 10
    while True:  # each round places one more ring of neighbours
        rest = nodes.select("id").join(placed, "id", "left_anti")
        new = cut(rest.join(nbr, "id").join(placed.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("id", (F.col("x") + jitter(1)).alias("x"), (F.col("y") + jitter(2)).alias("y")))
        if new.isEmpty():
            break
        placed = cut(placed.unionByName(new))
    rest = nodes.select("id").join(placed, "id", "left_anti").withColumn("k", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double"))
    angle, radius = F.col("k") * (math.pi * (3 - math.sqrt(5))), 20 * F.sqrt("k")
    return placed.unionByName(rest.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y")))


def best_snapshot(nodes: DataFrame, snapshots: DataFrame, least: float = 0.6) -> DataFrame:
    """snapshot, coverage of the stored layout (snapshot, id) that places most nodes; none if that is too few."""
    total = nodes.agg(F.count("*").alias("n"))
    covered = snapshots.join(nodes.select("id"), "id", "left_semi").groupBy("snapshot").agg(F.countDistinct("id").alias("c"))
    return covered.crossJoin(F.broadcast(total)).select("snapshot", (F.col("c") / F.col("n")).alias("coverage")).where(F.col("coverage") >= least).orderBy(F.desc("coverage"), "snapshot").limit(1)  # one row
