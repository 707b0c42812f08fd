"""Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(name: str) -> Column:
    return F.format_string("%.2f", F.col(name))


def related_report(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """id, text: a table of the pages related to each page; ranked has id, rank, other, label_other and the signals."""
    row = F.concat(F.lit("| [["), F.col("other").cast("string"), F.lit("\\|"), F.col("label_other"), F.lit("]] | "), F.concat_ws(" | ", *map(_cell, ("total", "direct_link", "adamic_adar", "source_overlap", "co_citation"))), F.lit(" |"))
    rows = ranked.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", row.alias("row"))))["row"], "\n").alias("rows"))
    head = F.concat(F.lit("# "), F.col("label"), F.lit("\n\n- type: "), F.col("raw_type"), F.lit("\n- links: "), F.col("link_count").cast("string"), F.lit("\n- community: "), F.col("community").cast("string"), F.lit("\n\n## Related pages\n\n| page | total | direct | Adamic-Adar | sources | co-cited |\n| --- | ---: | ---: | ---: | ---: | ---: |\n"))
    return nodes.join(rows, "id").select("id", F.concat(head, "rows").alias("text"))


def insights_report(nodes: DataFrame, edges: DataFrame, communities: DataFrame, connections: DataFrame, gaps: DataFrame, today: str) -> DataFrame:
    """One row, value: counters, surprising links and gaps, each a few ranked rows."""
    count = lambda df, name: df.agg(F.count("*").cast("string").alias(name))
    one = count(nodes, "n").crossJoin(count(edges, "e")).crossJoin(count(communities, "c"))  # one row each
    lines = connections.agg(F.array_join(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.format_string("- **%s - %s**: weight %.2f, score %d", F.col("a").cast("string"), F.col("b").cast("string"), "weight", F.col("score").cast("int")).alias("t"))))["t"], "\n").alias("links"))
    holes = gaps.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("### "), "kind", F.lit(" "), "anchor", F.lit(": "), F.col("n").cast("string")))), "\n").alias("gaps"))
    text = F.concat(F.lit(f"---\ntype: overview\ncreated: {today}\n---\n\n# Graph insights\n\n- pages: "), "n", F.lit("\n- links: "), "e", F.lit("\n- communities: "), "c", F.lit("\n\n## Surprising links\n\n"), "links", F.lit("\n\n## Gaps\n\n"), "gaps")
    return one.crossJoin(lines).crossJoin(holes).select(text.alias("value"))


def index_note(nodes: DataFrame, title: str, groups: int = 64) -> DataFrame:
    """One row, value: a list of links to nodes (id, label), in two steps."""
    line = F.concat(F.lit("- [["), F.col("id").cast("string"), F.lit("|"), "label", F.lit("]]"))
    parts = nodes.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("label", "id", line.alias("t"))).alias("l"))
    return parts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.array_sort(F.flatten(F.collect_list("l")))["t"], "\n")).alias("value"))
