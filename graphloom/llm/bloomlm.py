"""Language-model scoring from a log-frequency Bloom filter.

The filter holds, for each n-gram, its count on a logarithmic scale: an n-gram of
level q is entered as (n-gram, 1) to (n-gram, q), so its level is found by probing
1, 2, ... until a probe fails, and an error can only raise a level.  All words and
all pairs of words of the training texts are in it.  It is cut into segments by
hash, each as large as its entries need, so it grows with the corpus.

Counting is exact and distributed: batches reduce their tokens to distinct hashes,
packed by segment, and each segment is counted and built in a task of its own; there
are so many segments that one has a bounded number of tokens.  A filter of up to
``BROADCAST`` bytes is sent to the executors, as a file that all workers of one read in place.  A larger one stays where it is, and the
n-grams of slices of documents are sent to its segments; the levels, and with them
the scores, are the same either way.

The model is a word-pair model whose prior is the word model: p(w | u) is
(c(u w) + PRIOR p(w)) / (c(u) + PRIOR), and p(w) the base score's.  With exact counts
its probabilities add up to one.

Beside the model's score stands the base score, from exact counts: the commonest
words' counts are sent along (a bounded number), the counts of all other words are
joined by hash.  Tokens are known by 64-bit hashes; at a billion distinct words the
odds that any two share one are about one in forty.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, fold, lean, mix, release, slices, spare, stage, tidy

#: Probes per entry, and bits that an entry needs.
PROBES, PER_ENTRY = 4, 10
#: Tokens that a segment gets, about, at most.
PER_SEGMENT = 1 << 21
#: Bytes of a filter that is sent to the executors, at most.
BROADCAST = 128 << 20
#: Bytes of text that are counted, and scored, at once: a token has some dozens of numbers.
COUNTED, SCORED = 4 << 20, 2 << 20
#: Words whose counts are sent to the workers, at most.
COMMON = 400_000
#: How many observations the word model counts for.
PRIOR = 4.0
#: What a level multiplies a count by: words (0) and pairs (1).
BASES = (math.sqrt(2), 2.0)
#: Stand-ins for the start and the end of a text.
START, END, WORD = np.uint64(0x5354415254), np.uint64(0x454E44), np.uint64(0x574F5244)


class LogBloom:
    """Quantised counts of hashed n-grams in a bit array, cut by hash into segments that begin at edges (in bits)."""

    def __init__(self, bits: np.ndarray, edges: np.ndarray):
        self.bits, self.begin, self.size = bits, edges[:-1].astype(np.uint64), np.diff(edges).astype(np.uint64)

    @staticmethod
    def level(counts: np.ndarray, base: float) -> np.ndarray:
        """The level of each count: powers of base, from 1."""
        return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)

    @staticmethod
    def count(levels: np.ndarray, base: float) -> np.ndarray:
        """The count that stands for each level, 0 for level 0."""
        return np.where(levels > 0, np.sqrt(base ** np.maximum(levels - 1, 0) * np.maximum(1.0, base**levels - 1)), 0)

    def places(self, hashes: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * level % (1 << 64)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        segment = segment_of(hashes, len(self.size))
        begin, size = self.begin[segment], self.size[segment]
        for k in range(PROBES):
            yield begin + (h + np.uint64(k) * step) % size

    def add(self, hashes: np.ndarray, levels: np.ndarray) -> None:
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in self.places(hashes[levels >= q], q):
                np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing one level after the other."""
        out, live, q = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
        while len(live):
            hit = np.ones(len(live), bool)
            for at in self.places(hashes[live], q):
                hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            live = live[hit]
            out[live] = q
            q += 1
        return out


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each n-gram, by the top bits of its hash."""
    return ((hashes >> np.uint64(16)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams as the filter knows them: 48 bits, of which false answers come from far more seldom than from the filter."""
    return hashes >> np.uint64(16)


def six(hashes: np.ndarray) -> bytes:
    """Short hashes in six bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def opened(name: str, edges: np.ndarray) -> LogBloom:
    """The filter of a file sent with the job; its pages are in memory once for all workers of an executor."""
    return LogBloom(np.asarray(np.memmap(SparkFiles.get(name), np.uint8, "r")), edges)


def one_segment(bits: np.ndarray) -> LogBloom:
    """A segment by itself; probes of n-grams of that segment go to the same places as in the whole."""
    return LogBloom(bits, np.array([0, 8 * len(bits)]))


def fill(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bytes of a segment with these n-grams, as many as they need."""
    out = one_segment(np.zeros(max(8, -(-int(levels.sum()) * PER_ENTRY // 8)), np.uint8))
    out.add(hashes, levels)
    return out.bits


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each text followed by END; the first token of each."""
    words = Words(column)
    first = words.first + np.arange(len(words.first))
    out = np.full(len(words.starts) + len(words.first) - 1, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes()
    return out, first


def pairs(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token and the one before it, START before the first."""
    before = np.concatenate([[START], hashes[:-1]])
    before[first[:-1]] = START
    return mix(mix(before) ^ (hashes + np.uint64(1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, COUNTED):
            hashes, counts = np.unique(tokens(part.column(0))[0], return_counts=True)
            for k in range(0, len(hashes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], ["h", "c"])


#: How counts of words and of pairs are packed; a larger count is cut into several.
_COUNTS = (np.uint32, np.uint8)


def _packed(hashes: np.ndarray, counts: np.ndarray, segments: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows of (segment, kind, hashes, counts) of sorted short hashes; segments are ranges of hashes."""
    most = np.iinfo(_COUNTS[kind]).max
    if len(counts) and counts.max() > most:
        times = -(-counts // most)
        last = np.cumsum(times) - 1
        hashes, rest = np.repeat(hashes, times), counts - (times - 1) * most
        counts = np.full(len(hashes), most)
        counts[last] = rest
    edges = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
    filled = np.flatnonzero(np.diff(edges))
    small = counts.astype(_COUNTS[kind])
    for at in range(0, len(filled), 1_024):
        some = filled[at : at + 1_024]
        blobs = [six(hashes[edges[k] : edges[k + 1]]) for k in some], [small[edges[k] : edges[k + 1]].tobytes() for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), *[pa.array(x, pa.binary()) for x in blobs]], ["segment", "kind", "hashes", "counts"])


def _build_segment(table: pa.Table) -> pa.Table:
    spare()  # what the segment before left
    kinds, hashes, levels = table["kind"].to_numpy(), [], []
    for kind, base in enumerate(BASES):
        mine = table.filter(pa.array(kinds == kind))
        if mine.num_rows:
            found, back = np.unique(unsix(b"".join(mine["hashes"].to_pylist())), return_inverse=True)
            hashes.append(found)
            levels.append(LogBloom.level(np.bincount(back, np.frombuffer(b"".join(mine["counts"].to_pylist()), _COUNTS[kind])), base))
    bits = fill(np.concatenate(hashes), np.concatenate(levels))
    return pa.table({"segment": pa.array([table["segment"][0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary()), "size": pa.array([len(bits)], pa.int64())})


class Grams:
    """The distinct words and pairs of some texts, and the keys by which the filter has them: words first."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.words, self.word = np.unique(hashes, return_inverse=True)
        both, self.pair = np.unique(short(pairs(hashes, first)), return_inverse=True)
        self.keys = np.concatenate([short(mix(self.words ^ WORD)), both])
        self.first = first

    def log10(self, levels: np.ndarray, norm: float) -> np.ndarray:
        """The log10 probability of each token after the one before it, from the levels of the keys."""
        n = len(self.words)
        alone, paired = LogBloom.count(levels[:n], BASES[0])[self.word], LogBloom.count(levels[n:], BASES[1])[self.pair]
        before = np.concatenate([[0.0], alone[:-1]])
        ends = np.searchsorted(self.words, END)
        before[self.first[:-1]] = LogBloom.count(levels[ends : ends + 1], BASES[0])[0]  # texts start as often as they end
        p = np.minimum(1.0, (alone + 0.1) / 10**norm)
        return np.log10((np.minimum(paired, before) + PRIOR * p) / (before + PRIOR))


class Model:
    """The segments of the filter (segment, bits, size), the totals, and the counts of the commonest words."""

    def __init__(self, built: DataFrame, segments: int, tokens_: int, types: int, common: np.ndarray, counts: np.ndarray):
        self.built, self.segments, self.n, self.v = built, segments, tokens_, types
        self.common, self.counts = common, counts
        self.norm = math.log10(self.n + 0.1 * (self.v + 1))
        self.bytes = built.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def whole(self) -> tuple[str, np.ndarray]:
        """The name of a file sent to the executors that has the filter in one piece, and the edges of its segments."""
        spark, size = self.built.sparkSession, np.full(self.segments, 8)
        for r in self.built.select("segment", "size").collect():
            size[r.segment] = r["size"]
        edges = np.concatenate([[0], np.cumsum(size)])
        folder = tempfile.mkdtemp(prefix="graphloom-filter-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder, f"filter-{uuid.uuid4().hex}")
        with path.open("wb") as out:
            out.truncate(int(edges[-1]))
            for r in self.built.select("segment", "bits").toLocalIterator():
                out.seek(int(edges[r.segment]))
                out.write(r.bits)
        spark.sparkContext.addFile(str(path))
        return path.name, 8 * edges


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of docs, and the counts (h, c) of all their tokens; null texts count as empty."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(texts.mapInArrow(lean(_count_words), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count at which the commonest words are few enough
    least, so_far = 1 << 62, 0
    for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect():
        if (so_far := so_far + r.n) > COMMON:
            break
        least = r.c
    top = counts.where(F.col("c") >= least).toArrow()
    common, often = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(common)
    common, often = common[order], often[order]
    segments = max(64, 1 << max(0, int(n) // PER_SEGMENT).bit_length())

    def pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, COUNTED):
                yield from _packed(*np.unique(short(pairs(*tokens(part.column(0)))), return_counts=True), segments, 1)

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = short(mix(batch.column(0).to_numpy().view(np.uint64) ^ WORD))
            order = np.argsort(keys)
            yield from _packed(keys[order], batch.column(1).to_numpy()[order], segments, 0)

    schema = "segment int, kind int, hashes binary, counts binary"
    packed = texts.mapInArrow(lean(pack_pairs), schema).unionByName(counts.mapInArrow(lean(pack_words), schema))
    built = stage(packed.groupBy("segment").applyInArrow(_build_segment, "segment int, bits binary, size long"))
    tidy(docs.sparkSession)
    return Model(built, segments, int(n), int(v), common, often), counts


_SEEN = "row long, doc_id long, n_tokens long, n_common long, base double, score double, rare array<long>, times array<long>"


def _scored(row: int, ids: pa.Array, hashes: np.ndarray, first: np.ndarray, chances: np.ndarray, common: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """What is known of texts without the counts of rarer words, and the words of which these are needed."""
    n = len(ids)
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    base = np.where(known, np.log10((counts[at] if len(common) else 0) + 0.1), 0)
    rare = [np.unique(x[k], return_counts=True) for x, k in zip(np.split(hashes, first[1:-1]), np.split(~known, first[1:-1]), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row + np.arange(n)),
            ids,
            pa.array(np.diff(first)),
            pa.array(np.bincount(doc, known, n).astype(np.int64)),
            pa.array(np.bincount(doc, base, n)),
            pa.array(np.bincount(doc, chances, n)),
            pa.array([x[0].view(np.int64) for x in rare], pa.list_(pa.int64())),
            pa.array([x[1] for x in rare], pa.list_(pa.int64())),
        ],
        [f.split()[0] for f in _SEEN.split(", ")],
    )


def _seen_by_broadcast(texts: DataFrame, model: Model) -> DataFrame:
    """_SEEN of texts (doc_id, text), where the filter is sent to the executors."""
    (name, edges), norm = model.whole(), model.norm
    sent = texts.sparkSession.sparkContext.broadcast((model.common, model.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, common, row = opened(name, edges), sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, SCORED):
                hashes, first = tokens(part.column(1))
                grams = Grams(hashes, first)
                yield _scored(row, part.column(0), hashes, first, grams.log10(bloom.levels(grams.keys), norm), *common)
                row += part.num_rows

    return stage(texts.mapInArrow(lean(run), _SEEN))


def _seen_by_segment(texts: DataFrame, model: Model) -> DataFrame:
    """_SEEN of texts (doc_id, text), where the n-grams of slices of texts go to the segments, and their levels come back."""
    segments, norm = model.segments, model.norm
    sent = texts.sparkSession.sparkContext.broadcast((model.common, model.counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                edges = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([row]), *[pa.ListArray.from_arrays(edges, part.column(k)) for k in (0, 1)]], ["slice", "ids", "texts"])
                row += part.num_rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = np.sort(Grams(*tokens(batch.column(2)[k].values)).keys)
                for part in _packed(keys, np.zeros(0, np.int64), segments, 0):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, batch.column(0)[k].as_py())), part.column(2)], ["segment", "slice", "hashes"])

    def probe(asked: pa.Table, built: pa.Table) -> pa.Table:
        spare()
        bloom = one_segment(np.frombuffer(built["bits"][0].as_py(), np.uint8)) if built.num_rows else None
        levels = [bloom.levels(h).astype(np.uint8).tobytes() if bloom else bytes(len(h)) for h in map(unsix, asked["hashes"].to_pylist())]
        return pa.table({"slice": asked["slice"], "segment": asked["segment"], "levels": pa.array(levels, pa.binary())})

    def rate(given: pa.Table, answers: pa.Table) -> pa.Table:
        spare()
        ids, column = given["ids"].combine_chunks().flatten(), given["texts"].combine_chunks().flatten()
        hashes, first = tokens(column)
        grams = Grams(hashes, first)
        found = np.frombuffer(b"".join(answers.sort_by("segment")["levels"].to_pylist()), np.uint8)
        levels = np.empty(len(found), np.int64)
        levels[np.argsort(grams.keys, kind="stable")] = found
        return pa.Table.from_batches([_scored(given["slice"][0].as_py(), ids, hashes, first, grams.log10(levels, norm), *sent.value)])

    parts = stage(texts.mapInArrow(lean(cut), "slice long, ids array<long>, texts array<string>"))
    asked = parts.mapInArrow(lean(ask), "segment int, slice long, hashes binary")
    answers = asked.groupBy("segment").cogroup(model.built.groupBy("segment")).applyInArrow(probe, "slice long, segment int, levels binary")
    out = stage(parts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(rate, _SEEN))
    release(parts)
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text of docs.

    A null text counts as empty and has its end token alone.  Rows stay rows,
    repeated ones too; very long texts count whole, further columns play no part, and
    of an empty table nothing comes.  With nothing learned, n_known is 0 and both
    scores are those of V = N = 0.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    seen = (_seen_by_broadcast if model.bytes <= BROADCAST else _seen_by_segment)(texts, model)
    rest = seen.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rest.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    return seen.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(model.norm)).alias("base_score"),
        "score",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document under a model of those of which crc32(doc_id) mod 10 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = train(docs.where(fold("doc_id", 10) != 0))
    out = score(docs, model, counts)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
