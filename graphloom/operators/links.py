"""From link texts to the directed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import basename, hyphened, spaced, trim, without_md


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def claims() -> Column:
    """The spellings that a note (id, basename, aliases) claims: an array of tier, sub and key.

    Ids claim spellings before their hyphen and space forms do, those before file names, those before aliases.
    """
    low = lambda c: F.lower(trim(c))
    entry = lambda tier, sub, key: F.struct(F.lit(tier).alias("tier"), F.lit(sub).alias("sub"), key.alias("key"))
    own, name = F.col("id"), F.col("basename")
    fixed = [entry(1, 0, low(own)), entry(2, 0, hyphened(own)), entry(2, 1, spaced(own)), entry(3, 0, low(name)), entry(3, 1, hyphened(name)), entry(3, 2, spaced(name))]
    plain = lambda a: F.regexp_replace(a, r"^\./", "")
    others = F.flatten(F.transform("aliases", lambda a: F.array(entry(4, 0, low(plain(a))), entry(4, 1, hyphened(plain(a))))))
    return F.filter(F.concat(F.array(*fixed), F.coalesce(others, F.array().cast("array<struct<tier:int,sub:int,key:string>>"))), lambda e: e["key"] != "")


def spellings(target: Column) -> Column:
    """What a link's target may be claimed as, the likeliest first."""
    t = without_md(F.regexp_replace(trim(target), r"^\./", ""))
    return F.array(t, F.lower(t), F.lower(basename(t)), hyphened(t), spaced(t), hyphened(basename(t)), spaced(basename(t)))


def link_keys(notes: DataFrame) -> DataFrame:
    """key, id: the page that each spelling means: that of the first tier, and within a tier the first note by id."""
    rows = notes.select("id", F.explode(claims()).alias("k")).select("id", "k.*")
    return first_wins(rows, "key", "tier", "id", "sub").select("key", "id")


def resolve_links(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """refs (id, target) with resolved: the first of a target's spellings that keys knows, null if none.

    Names are made from small columns, so files tell little of their size: no side is broadcast.
    """
    tried = refs.select("target").distinct().select("target", F.posexplode(spellings(F.col("target"))).alias("pos", "key"))
    found = tried.join(keys.select("key", F.col("id").alias("to")).hint("merge"), "key").groupBy("target").agg(F.min_by("to", "pos").alias("resolved"))
    return refs.join(found.hint("merge"), "target", "left").select("id", "target", "resolved")


def resolve_in_two(refs: DataFrame, keys: DataFrame, wider: DataFrame) -> DataFrame:
    """refs with resolved, by keys or else by wider, and local: whether keys knew it."""
    near = resolve_links(refs, keys).withColumnRenamed("resolved", "near")
    far = resolve_links(refs.select("id", "target").distinct(), wider).withColumnRenamed("resolved", "far")
    return near.join(far.hint("merge"), ["id", "target"], "left").select("id", "target", F.coalesce("near", "far").alias("resolved"), F.col("near").isNotNull().alias("local"))


def unresolved(resolved: DataFrame) -> DataFrame:
    """id, target: distinct targets that nothing resolves."""
    return resolved.where("resolved IS NULL").select("id", F.trim("target").alias("target")).distinct()


def directed(resolved: DataFrame) -> DataFrame:
    """src, dst: distinct links between different pages."""
    return resolved.where("resolved IS NOT NULL AND resolved <> id").select(F.col("id").alias("src"), F.col("resolved").alias("dst")).distinct()


def undirected(links: DataFrame) -> DataFrame:
    """a < b of each linked pair."""
    return links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, nbr, either way, distinct; between pages of nodes only, if given."""
    und = undirected(links)
    if nodes is not None:
        ids = nodes.select("id").distinct()
        und = und.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"))))
    return und.select(both.alias("x")).select("x.id", "x.nbr")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, out_links, in_links, link_count of every node."""
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))
    out = nodes.select("id").join(sums, "id", "left").na.fill(0, ["out_links", "in_links"])
    return out.withColumn("link_count", F.col("out_links") + F.col("in_links"))
