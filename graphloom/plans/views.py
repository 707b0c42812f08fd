"""A graph made from relational tables: parts as pages, neighbours in an order as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import millis

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a part and the next one in an order, over all orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source: a part and its suppliers of large quantities."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("source")).distinct()


def part_nodes(spark: SparkSession, sf_dir: str, links: DataFrame) -> DataFrame:
    """Parts as pages: id, label, path, raw_type, type, tags, community, is_structural, created, modified and link counts."""
    from graphloom.operators.links import degrees

    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ["concept", "source", "entity", "synthesis", "query", "thesis"]))
    n = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("parts/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_type").alias("raw_type"), F.get(kinds, F.pmod(F.col("p_partkey"), F.lit(6)).cast("int")).alias("type"), F.array("p_brand").alias("tags"),
        F.pmod(F.col("p_size"), F.lit(8)).cast("long").alias("community"), (F.col("p_size") == 1).alias("is_structural"),
    )
    ships = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(millis(F.col("l_shipdate"))).alias("created"), F.max(millis(F.col("l_shipdate"))).alias("modified"))
    d = degrees(n, links)
    return n.join(ships, "id", "left").join(d, "id").withColumn("vault_link_count", F.col("link_count"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a web page and every address that it links to, on its own host unless told; sparse by nature, as many addresses stand on one page only."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("src"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.explode(hrefs).alias("href"))
    return pages.select("src", F.when(F.startswith("href", F.lit("/")), F.concat("host", "href")).otherwise(F.col("href")).alias("dst")).distinct()


def page_nodes(links: DataFrame) -> DataFrame:
    """id, is_structural, community of both ends of page_links: an address that names scaffolding is that, and pages are in one community with the first address that they link to."""
    from graphloom.functions.scalars import basename, structural_name

    first = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("community"))
    to = links.select(F.col("dst").alias("id"), F.col("dst").alias("community")).distinct()
    return first.unionByName(to).withColumn("is_structural", structural_name(basename(F.col("id"))))
