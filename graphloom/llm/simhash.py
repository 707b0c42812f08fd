"""SimHash fingerprints, and near duplicates by multi-index hashing.

The 64 bits fall into segments.  Of two fingerprints that differ in at most four
bits, some segment differs in at most one (three segments, radius one) or two (two
segments, radius two), so each fingerprint looks up, part by part, the small Hamming ball around its own
value in the table of all fingerprints, in the half of greater values; what is
found counts as a link only if the complete distance is small enough.  Equal fingerprints are one entry of the
table, so a group of copies costs what one row does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, sift, stage, unused

#: Distinct fingerprints up to which three segments are used; beyond it their 21 bits would be shared by too many, and two are.
FEW = 1 << 24


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned SimHash of the size-word shingles of a text; zero without words."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < size:
        hashes = [digest(joined, 42)]
    else:
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :])]  # noqa: B905  the last starts have no end
    set_bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, size: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every text of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, fp long")


def balls(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(mask, flip, top) of each lookup: the segment's own value with up to distance // segments bits flipped, top the greatest of them.

    A flip holds the bit after the segment too, which marks keys as this segment's.
    """
    radius, out = distance // segments, []
    edges = [64 * k // segments for k in range(segments + 1)]
    for low, high in zip(edges, edges[1:], strict=False):
        mask, mark, flips = (1 << high) - (1 << low), 1 << high % 64, {0}
        for _ in range(radius):
            flips |= {f ^ (1 << bit) for f in flips for bit in range(low, high)}
        out += [(mask, f | mark, f and 1 << f.bit_length() - 1) for f in sorted(flips) if f.bit_count() <= radius]
    return [tuple(x - (1 << 64) if x >> 63 else x for x in probe) for probe in out]


def links(table: DataFrame, *, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs a < b of distinct values of column fp that differ in at most distance bits.

    Where two values of a segment differ, only the lesser looks the greater one up:
    a pair needs to be met from one side, and half of each ball suffices.
    """
    probes = balls(distance, segments)
    structs = lambda found: F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip("mft", p, strict=True)]) for p in found])
    key = lambda fp: F.col(fp).bitwiseAND(F.col("p.m")).bitwiseXOR(F.col("p.f")).alias("key")
    ask = table.select(F.col("fp").alias("x"), F.explode(structs(probes)).alias("p")).where(F.col("x").bitwiseAND(F.col("p.t")) == 0).select("x", key("x"))
    have = table.select(F.col("fp").alias("y"), F.explode(structs([p for p in probes if not p[2]])).alias("p")).select("y", key("y"))
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    found = ask.alias("ask").join(have.alias("have"), (F.col("ask.key") == F.col("have.key")) & near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component of every end of the edges (a, b), two longs; component is the least node reachable.

    Each round hooks every node to its least neighbour, shortens the chains that
    this makes, and carries the edges over to the roots; rounds halve the nodes at
    least, and each is written to the shared folder.
    """
    rest = stage(edges.where("a <> b").select("a", "b").distinct())
    member: DataFrame | None = None
    while True:
        ends = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        if up.isEmpty():
            break
        for _ in range(2):
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            up = up.join(higher, "up").select("node", F.col("upper").alias("up"))
        up = stage(up)
        over = lambda df, c, m=up: df.join(m.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        member = up.select("node", F.col("up").alias("component")) if member is None else over(member, "component")
        member = stage(member)
        rest = stage(over(over(rest, "a"), "b").where("a <> b").distinct())
    if member is None:
        member = rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return member


def near_duplicates(docs: DataFrame, *, distance: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row of docs: component_id is the least doc_id that links reach.

    Rows whose fingerprints are equal, or differ in at most ``distance`` bits, are
    linked; empty texts have fingerprint zero and link like others.  A row without
    a doc_id links too, but names no component; where all are, it is null.  Rows stay rows, repeated ones too;
    very long texts count whole, further columns play no part, and of an empty table
    nothing comes.  The number of segments changes the work, not the result.
    """
    fps = stage(fingerprints(docs))
    # fingerprints themselves are what links connect, so doc_ids may be any numbers
    table = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    root = components(links(table.select("fp"), distance=distance, segments=segments or (3 if table.count() <= FEW else 2)))
    of = table.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("c"))
    least = of.groupBy("c").agg(F.min("id").alias("component_id"))
    return fps.join(of.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash of every document, and the least doc_id of its group."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of near duplicates stays: that of the least doc_id.

    Of several rows with that doc_id the one of the least text stays.  Rows without
    a doc_id stay, once per text.
    """
    own, (ident, rows, row) = docs.columns, unused(docs, "ident", "rows", "row")
    marked = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias(rows))
    # only the documents that go, or whose doc_id is repeated, need be dealt out
    odd = stage(marked.where((F.col("doc_id") != F.col("c")) | (F.col(rows) > 1)).select("doc_id", F.col("doc_id").alias(ident), "c", rows))
    maybe, other = sift(docs.where("doc_id IS NOT NULL"), ["doc_id"], odd)
    out = other.unionByName(maybe.join(odd.select(ident), docs["doc_id"] == F.col(ident), "left_anti"))
    out = out.unionByName(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]))
    again = odd.where(f"doc_id = c AND {rows} > 1").select(ident)
    if again.isEmpty():
        return out
    several = maybe.join(again, docs["doc_id"] == F.col(ident), "left_semi")
    # least first, before and after the shuffle: the rows of one doc_id never meet
    several = several.groupBy(F.col("doc_id").alias(ident)).agg(F.min_by(F.struct(*own), F.struct("text")).alias(row)).select(f"{row}.*")
    return out.unionByName(several)
