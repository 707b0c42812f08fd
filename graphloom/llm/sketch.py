"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every five-word shingle whose hash lies below ``1 / SCALE`` of the
range: the same bound for every text, so a sketch grows with its document, that of a
union is the union of the sketches, and containment is estimated on what is retained
even where a page is compared with a book.  A retained hash is kept as its 32 bits
below the bound.  Beside them stands the sum of all shingles' hashes, which tells
texts apart of which nothing was retained, as may happen to very short ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Words, partitions, shingles

#: One shingle in SCALE is retained.
SIZE, SCALE = 5, 2
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sketch:
    """Sorted distinct 32-bit values of the hashes below the bound, and the sum of all hashes (0 for no shingles, or after merging)."""

    def __init__(self, values: np.ndarray, total: int = 0):
        self.values, self.total = values, total

    @classmethod
    def of(cls, hashes: np.ndarray, scale: int = SCALE) -> Sketch:
        every = np.unique(hashes)
        bound = np.uint64(int(_TOP) // scale)
        # the 32 bits below the bound's own leading zeros
        low = (every[every <= bound] >> np.uint64(bound.item().bit_length() - 32)).astype(np.uint32)
        return cls(np.unique(low), int(every.sum(dtype=np.uint64)))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts together."""
        return Sketch(np.union1d(self.values, other.values))

    def containment(self, other: Sketch) -> float:
        """The estimated share of this text's shingles that the other has, 0 to 1; where nothing is retained, whether all shingles are the same."""
        if not len(self.values):
            return float(not len(other.values) and self.total == other.total)
        return float(np.isin(self.values, other.values, assume_unique=True).mean())

    def likeness(self, other: Sketch) -> float:
        """The larger containment of the two; where either retains nothing, whether both have the same shingles."""
        if not len(self.values) or not len(other.values):
            return float(len(self.values) == len(other.values) and self.total == other.total)
        return max(self.containment(other), other.containment(self))

    def text(self) -> str:
        """The sum and the values, in base64."""
        return base64.b64encode(np.array([self.total], "<u8").tobytes() + self.values.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Sketch:
        data = base64.b64decode(text)
        return cls(np.frombuffer(data, "<u4", offset=8), int(np.frombuffer(data[:8], "<u8")[0]))


def sketches(texts: list[str], size: int = SIZE, scale: int = SCALE) -> list[Sketch]:
    words = Words(pa.array(texts, pa.large_string()))
    hashes, first = shingles(words, words.hashes(), size)
    return [Sketch.of(hashes[a:b], scale) for a, b in zip(first, first[1:], strict=False)]


def with_next(docs: DataFrame, *, rows_per_block: int = 2_000) -> DataFrame:
    """doc_id, text, next_text: each row's successor by descending doc_id, then text; that of the last is the first.

    A null doc_id comes last; a null text counts as empty.  No task sees the whole
    order: rows go to blocks of neighbouring doc_ids, whose edges are quantiles of
    the ids alone, and the first rows of a block also go to the block before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long"))
    total = ids.count()
    blocks = max(1, min(total // rows_per_block, 8 * partitions(spark)))
    edges = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / blocks for k in range(1, blocks)], 0.25 / blocks)}) if blocks > 1 else []
    # the number of edges above an id: the block's place in descending order; edges and blocks are as many as partitions, not rows
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("doc_id"))) if edges else F.lit(0)
    place = F.when(F.col("doc_id").isNull(), F.lit(len(edges) + 1)).otherwise(place)
    heads = ids.groupBy(place.alias("block")).agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    before = {r.head: heads[k - 1].block for k, r in enumerate(heads)}  # of the first block, the last
    if not before:
        return rows.withColumn("next_text", F.lit(""))
    lead = [(h, b) for h, b in before.items()]
    extra = spark.createDataFrame(lead, "head long, to int")
    own = rows.select("doc_id", "text", place.alias("block"), F.lit(0).alias("late"))
    copies = rows.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("block"), F.lit(1).alias("late"))
    order = Window.partitionBy("block").orderBy("late", F.desc_nulls_last("doc_id"), "text")
    return own.unionByName(copies).withColumn("next_text", F.lead("text").over(order)).where("late = 0").select("doc_id", "text", "next_text")


def edited(text: str, then: str) -> str:
    """text, the last half of whose characters give way to the first as many of then."""
    half = len(text) // 2
    return text[: len(text) - half] + then[:half]


def compare_with_edits(docs: DataFrame, *, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The fingerprint of every text and of its edited text, and how alike they are.

    Rows stay rows; a null text counts as empty, and of an empty table nothing
    comes.  near_edited and near_next are the larger containment, 0 to 1, of equal
    texts 1.  Texts of any length count whole; further columns play no part.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_retained long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, then = part.column(1).to_pylist(), [t or "" for t in part.column(2).to_pylist()]
                new = [edited(a, b) for a, b in zip(texts, then, strict=True)]
                mine, theirs, others = (sketches(x, size, scale) for x in (texts, new, then))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                        pa.array([s.text() for s in mine], pa.string()),
                        pa.array([s.text() for s in theirs], pa.string()),
                        pa.array([a.likeness(b) for a, b in zip(mine, theirs, strict=True)], pa.float64()),
                        pa.array([a.likeness(b) for a, b in zip(mine, others, strict=True)], pa.float64()),
                        pa.array([len(s.values) for s in mine], pa.int64()),
                    ],
                    names,
                )

    return with_next(docs).mapInArrow(run, schema)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text."""
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
