"""Documents whose sets of word shingles are alike, joined by parity sketches.

A set's sketch is a row of bits, grouped in segments; every shingle flips one bit.
So a shingle that two sets share flips the same bit in both, and the sketches differ
in at most as many bits as the sets differ in shingles.  A Jaccard similarity of at
least s bounds the difference of two sets by their sizes: at most
k = (1 - s) / (1 + s) of the sum.  Sizes fall into bands, each with its own k and
segments, more than k of them: by the pigeonhole principle two similar sets then
agree on a segment.  What is more, of S segments they agree on S - k, so if both put
their segments in one order, fullest first, and keep k + 1 of them, some segment
that both keep is the same.  Segments of few bits, which unlike sets share by chance
or by a common line, come last in that order and are seldom kept.

Sets that keep the same segment are compared with the least of them, exactly.  Where
that doesn't link all of them, the rest is made up in blocks: of the sets that such
segments connect, every two of a fitting size are compared as matrix products of
bounded blocks, and a block gives back a spanning forest of what it has linked.  So
a large group of near copies costs neither all its pairs as rows nor a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, mix, release, shingles, sift, slices, stage
from graphloom.llm.simhash import components

#: Bits of a segment, of which shingles set few.
WIDTH = 1 << 16
#: Segments for each one that is kept.
SPARE = 1.3
#: Sets, and shingles, of a block at most; a larger set is a block of its own.
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 400_000
#: Bytes of text that are tokenised at once.
SLICE = 1 << 20


class Bands:
    """The bands of set sizes for a similarity of percent / 100 or more, in whole numbers throughout."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("a similarity of 50 to 100 percent")
        self.percent, self.top = percent, [1]

    def difference(self, a: int, b: int) -> int:
        """The most shingles that sets of these sizes may differ in."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def largest(self, n: int) -> int:
        """The size of the largest set that one of size n can be like."""
        return 100 * n // self.percent

    def reach(self, n: int) -> None:
        while self.top[-1] < n:
            self.top.append(max(self.top[-1] + 1, self.largest(self.largest(self.top[-1]))))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size: that of the first top which isn't less."""
        self.reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.top), sizes)

    def kept(self) -> np.ndarray:
        """Of each band, the segments that are kept: one more than the sets of a pair whose smaller set is in it may differ in."""
        return np.array([self.difference(t, self.largest(t)) + 1 for t in self.top])


def set_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in rising order, one text after the other, and where each text's begin."""
    words = Words(column)
    hashes, first = shingles(words, words.hashes(), size)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(first)))


def identities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each set, by what is in it alone; of no use where a set is empty."""
    if not len(hashes):
        return np.zeros(len(first) - 1, np.int64)
    out = np.zeros(len(first) - 1, np.uint64)
    there = np.flatnonzero(np.diff(first))
    out[there] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first[there])
    return mix(out + np.diff(first).astype(np.uint64)).view(np.int64)


def kept_segments(hashes: np.ndarray, first: np.ndarray, band: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept segments of each set's parity sketch as keys, and where each set's begin.

    band and keep: each set's band, which a key belongs to, and how many of its segments are kept; none of a set for which that is 0.
    """
    sizes = np.diff(first)
    count = np.where(keep > 0, np.maximum(keep + 1, np.ceil(SPARE * keep).astype(np.int64)), 0)
    base = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    used = count[doc] > 0
    h, doc = hashes[used], doc[used]
    # the high half of a hash chooses the segment, the low bits the place in it
    segment = base[doc] + ((h >> np.uint64(32)) * count[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    bits = np.sort(segment.astype(np.uint64) * np.uint64(WIDTH) | h & np.uint64(WIDTH - 1))
    edge = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1], [True]])) if len(bits) else np.zeros(1, np.int64)
    bits = bits[edge[:-1][np.diff(edge) % 2 == 1]]  # what an even number of shingles flipped is zero
    of = (bits // np.uint64(WIDTH)).astype(np.int64)
    full = np.bincount(of, minlength=base[-1])
    content = np.zeros(base[-1], np.uint64)
    if len(of):
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        content[of[begin]] = np.bitwise_xor.reduceat(mix((bits & np.uint64(WIDTH - 1)) + np.uint64(1)), begin)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(base[-1]) - base[:-1][owner]
    keys = mix(content ^ mix((band[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)))
    rank = np.uint64(63) - np.minimum(full, 63).astype(np.uint64)
    order = np.lexsort((rank << np.uint64(58) | keys >> np.uint64(6), owner))
    chosen = order[number < keep[owner]]  # number counts up along order too, as owners come one after the other
    return keys[chosen], np.concatenate([[0], np.cumsum(keep)])


def sketches(docs: DataFrame, *, size: int = 4, percent: int = 85) -> DataFrame:
    """row, doc_id, n, node, keys of every text: the size of its set, the set's number (null if it is empty), and the segments it keeps.

    It keeps segments of its own band and, if it can be the larger one of a pair across
    bands, of the band before.  In a band where no two different sets are alike none are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                hashes, first = set_hashes(part.column(2), size)
                sizes = np.diff(first)
                own = bands.of(sizes)
                kept, tops = bands.kept(), np.array([*bands.top, 0])
                guest = (own > 0) & (sizes <= np.array([bands.largest(t) for t in tops])[own - 1])
                found = []
                for band, there in ((own, sizes > 0), (own - 1, guest)):
                    # a bound of no difference leaves equal sets, which are one node anyway
                    k = np.where(there & (kept[np.maximum(band, 0)] > 1), kept[np.maximum(band, 0)], 0)
                    found.append(kept_segments(hashes, first, band, k))
                keys = np.concatenate([f for f, _ in found])
                doc = np.concatenate([np.repeat(np.arange(len(sizes)), np.diff(at)) for _, at in found])
                order = np.argsort(doc, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(sizes) + 1)), pa.int32()), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(identities(hashes, first), mask=sizes == 0), lists], ["row", "doc_id", "n", "node", "keys"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, node long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles of the sets in wanted (node, doc_id), once each: the hashes as bytes, in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                hashes, first = set_hashes(part.column(0), size)
                there = np.flatnonzero(np.diff(first))
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(identities(hashes, first)[there]), pa.array([raw[8 * first[k] : 8 * first[k + 1]] for k in there], pa.binary())], ["node", "shingles"])

    ids = stage(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct())
    named, _ = sift(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], ids)
    texts = named.unionByName(docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), "text"))
    nodes = stage(wanted.select("node").distinct())
    found, _ = sift(texts.select("text").mapInArrow(run, "node long, shingles binary"), ["node"], nodes)
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def alike(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of nodes whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            inter = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            ok = pa.array(alike(inter, np.array([len(p) for p in x], np.int64), np.array([len(q) for q in y], np.int64), percent))
            yield batch.select(["a", "b"]).filter(ok)

    both = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    # sizes that can't be alike need no comparison
    fits = 100 * F.least(F.length("x"), F.length("y")) >= percent * F.greatest(F.length("x"), F.length("y"))
    return both.where(fits).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of left shares with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    cols = column[: len(row[0])], column[len(row[0]) :]
    total = int(column.max(initial=-1)) + 1
    n = [np.bincount(c, minlength=total) for c in cols]
    work = n[0] * n[1]
    few = (work > 0) & (work <= 16)
    # rare hashes: their few pairs, one by one
    order = [np.argsort(c, kind="stable") for c in cols]
    begin = [np.concatenate([[0], np.cumsum(k)]) for k in n]
    hit = np.flatnonzero(few)
    times = work[hit]
    if len(hit):
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        c = np.repeat(hit, times)
        i = row[0][order[0][begin[0][c] + step // n[1][c]]]
        j = row[1][order[1][begin[1][c] + step % n[1][c]]]
        out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    # the others: products of zeros and ones, a bounded number of columns at a time
    often = np.flatnonzero(work > 16)
    place = np.full(total, -1)
    for at in range(0, len(often), 2_048):
        place[:] = -1
        some = often[at : at + 2_048]
        place[some] = np.arange(len(some))
        ones = []
        for k, sets in enumerate((left, right)):
            there = place[cols[k]] >= 0
            m = np.zeros((len(sets), len(some)), np.float32)
            m[row[k][there], place[cols[k][there]]] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def forest(nodes: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of links (pairs of places in nodes), as many as connect the same nodes."""
    up = list(range(len(nodes)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for i, j in pairs.tolist():
        if (p := top(i)) != (q := top(j)):
            up[max(p, q)] = min(p, q)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between members (grp, node, component, n) of one group and different components, by comparing all sets of fitting sizes, block by block."""
    ratio = float(np.log(100 / percent)) if percent < 100 else 1.0
    # by whole numbers: a set's band is at most one off that of any set it can be like
    level = F.floor(F.ln(F.col("n").cast("double")) / ratio + 1e-9).cast("int")
    rows = stage(members.withColumn("level", level))
    blocks = rows.groupBy("grp", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = rows.join(blocks, ["grp", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    above = blocks.select("grp", (F.col("level") - 1).alias("level"), F.col("blocks").alias("above"))
    below = blocks.select("grp", (F.col("level") + 1).alias("level"), F.col("blocks").alias("below"))
    placed = placed.join(above, ["grp", "level"], "left").join(below, ["grp", "level"], "left").na.fill(0, ["above", "below"])
    # a task compares block x of a level with block y of the same one or of the next
    task = lambda up, x, y, side: F.struct((F.col("level") - (1 if up and side else 0)).alias("low"), F.lit(up).alias("up"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    own, zero = F.col("block"), F.lit(0)
    tasks = F.concat(
        F.transform(span(own, F.col("blocks") - 1), lambda y: task(0, own, y, 0)), F.transform(span(zero, own - 1), lambda x: task(0, x, own, 1)),
        F.transform(span(zero, F.col("above") - 1), lambda y: task(1, own, y, 0)), F.transform(span(zero, F.col("below") - 1), lambda x: task(1, x, own, 1)),
    )
    dealt = placed.join(sets, "node").select("grp", "node", "component", "shingles", F.explode(tasks).alias("t")).select("grp", "t.*", "node", "component", "shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["up"].iloc[0] == 0 and pdf["x"].iloc[0] == pdf["y"].iloc[0]
        left = pdf[pdf["side"] == 0]
        right = left if same else pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        x, y = ([np.frombuffer(v, np.uint64) for v in s["shingles"]] for s in (left, right))
        sizes = [np.array([len(v) for v in s], np.int64) for s in (x, y)]
        inter = shared_counts(x, y).round().astype(np.int64)
        link = alike(inter, sizes[0][:, None], sizes[1][None], percent) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None])
        i, j = np.nonzero(link)
        nodes = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        found = forest(nodes, np.stack([i, j + (0 if same else len(left))], 1))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("grp", "low", "up", "x", "y").applyInPandas(compare, "a long, b long")


def near_classes(docs: DataFrame, *, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): component_id is the least doc_id that links reach.

    A document's set has the distinct runs of ``size`` of its words, or all its words as one
    run if it has fewer; a text that is null or without words has an empty set, which links
    with nothing.  Two documents link when their sets' Jaccard similarity is
    ``percent`` / 100 at least.  Rows stay rows: repeated ones link with each other, those without a
    doc_id link too but name no class.  Very long texts count whole, further columns play
    no part, and of an empty table nothing comes.  Shingles and sets are known by 64-bit hashes.
    """
    every = stage(sketches(docs, size=size, percent=percent))
    # equal sets are one node: only rows that another row stands for need be dealt out
    first = every.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    maybe, single = sift(every.where("node IS NOT NULL"), ["node"], stage(first.where("copies > 1").select("node")))
    nodes = single.unionByName(maybe.join(first.select("row"), "row", "left_semi"))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    met = stage(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("n > 1"))
    several = stage(met.where("n > 2").select("key"))
    there, _ = sift(keys, ["key"], several)
    groups = stage(there.join(met.where("n > 2").select("key", "least"), "key").select("key", "least", "node"))
    pairs = met.select(F.col("least").alias("a"), F.col("most").alias("b")).unionByName(groups.select(F.col("least").alias("a"), F.col("node").alias("b"))).where("a <> b")
    pairs = stage(pairs.distinct())
    ends = stage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    known, _ = sift(nodes.select("node", "doc_id", "n"), ["node"], ends)
    wanted = stage(known.join(ends, "node", "left_semi"))
    sets = stage(sets_of(docs, wanted, size))
    links = stage(verified(pairs, sets, percent))
    settled = components(links)
    # groups of three or more that their least set hasn't linked into one class
    own = groups.join(settled, "node", "left").select("key", "least", "node", F.coalesce("component", "node").alias("component"))
    open_ = stage(own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    left = stage(own.join(open_, "key", "left_semi").select("least", "node", "component").distinct())
    wide = components(left.select(F.col("least").alias("a"), F.col("node").alias("b")))
    members = left.select("node", "component").distinct().join(wide.select("node", F.col("component").alias("grp")), "node").join(wanted.select("node", "n"), "node")
    more = stage(rest_links(members, sets, percent))
    final = components(links.unionByName(more))
    named = every.select("row", "doc_id", F.col("n").alias("n_shingles"), "node")
    label = first.select("node").join(final, "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    # the least doc_id of each class; copies of a set meet in their task before they are shuffled
    ids = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id")).join(label, "node").groupBy("c").agg(F.min("id").alias("component_id"))
    # a document that is alone is its own class; the others look their class up
    classes = stage(label.join(ids, "c").select("node", "component_id").join(first.select("node", "copies"), "node").join(final.select("node", F.lit(True).alias("linked")), "node", "left").where("linked OR copies > 1").select("node", "component_id"))
    grouped, alone = sift(named, ["node"], classes.select("node"))
    grouped = grouped.join(classes.withColumn("found", F.lit(True)), "node", "left")
    out = grouped.select("doc_id", "n_shingles", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    release(groups, left, met)
    return out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, and the least doc_id of the documents that links of similar sets reach."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
