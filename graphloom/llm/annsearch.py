"""Approximate nearest neighbours with score-aware, four-bit product quantisation.

Vectors are scaled to unit length and cut into runs of a few dimensions, each coded
by one of sixteen codewords.  Codes and codebooks minimise a loss that weighs the
residual's part along the vector more than the part across it: for large inner
products, only the first changes the score.  A coarse partition sends a query to
the cells whose centroids are nearest; there, sums of entries of a table of the
query's sixteen partial scores per run rank all codes, and the best are scored
again, exactly, on the original vectors, twice as many until the last ones add nothing.

Equal vectors are one candidate that carries its least ids, and equal queries one
query, so copies cost nothing; a large cell is cut into blocks of bounded size,
which are searched apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stage

#: Codewords of a run: four bits.
WORDS = 16


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, lest squares over- or underflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of query and each of rows, in double precision, the same whatever stands beside a row."""
    top = np.abs(query).max()
    q, r = query / top, rows / np.abs(rows).max(1, keepdims=True)
    return (r * q).sum(1) / (np.sqrt((r * r).sum(1)) * np.sqrt((q * q).sum()))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


class Quantiser:
    """Codebooks of runs of dimensions, fitted to unit vectors under the anisotropic loss.

    The loss of a vector x and its residual r is |r|^2 + (eta - 1) (r.x)^2, where eta
    follows from the cosine ``threshold`` above which scores matter.
    """

    def __init__(self, x: np.ndarray, run: int = 4, threshold: float = 0.2, rounds: int = 6, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.dim, self.run = x.shape[1], run
        self.runs = -(-self.dim // run)
        self.extra = max(0.0, (self.dim - 1) * threshold**2 / (1 - threshold**2) - 1)
        parts = self.parts(x)
        self.books = np.stack([kmeans(parts[:, s], WORDS, rng) for s in range(self.runs)])
        for _ in range(rounds):
            self.books = self.fit(parts, self.encode(x))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Vectors by runs by dimensions of a run, filled up with zeros."""
        return np.pad(x, ((0, 0), (0, self.runs * self.run - self.dim))).reshape(len(x), self.runs, self.run)

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """The codes of unit vectors: each run's best, given the others', in turn."""
        parts = self.parts(x)
        # what each word would leave: its squared residual, and the part of it along x
        square = np.stack([((parts[:, s, None] - self.books[s]) ** 2).sum(2) for s in range(self.runs)], 1)
        along = np.stack([((parts[:, s, None] - self.books[s]) * parts[:, s, None]).sum(2) for s in range(self.runs)], 1)
        codes, rows = square.argmin(2), np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(passes):
            for s in range(self.runs):
                others = total - along[rows, s, codes[:, s]]
                codes[:, s] = (square[:, s] + self.extra * (others[:, None] + along[:, s]) ** 2).argmin(1)
                total = others + along[rows, s, codes[:, s]]
        return codes.astype(np.uint8)

    def fit(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The codebooks of least loss for these codes: one linear system."""
        n, size = len(parts), self.runs * WORDS * self.run
        left, right = np.zeros((size, size)), np.zeros(size)
        for at in range(0, n, 2_000):
            p, c = parts[at : at + 2_000], codes[at : at + 2_000]
            spots = ((np.arange(self.runs) * WORDS + c)[:, :, None] * self.run + np.arange(self.run)).reshape(len(p), -1)
            flat = p.reshape(len(p), -1)
            spread = np.zeros((len(p), size))
            np.put_along_axis(spread, spots, flat, 1)
            left += self.extra * spread.T @ spread
            np.add.at(left, (spots, spots), 1.0)
            np.add.at(right, spots, flat * (1 + self.extra * (flat**2).sum(1, keepdims=True)))
        left[np.arange(size), np.arange(size)] += 1e-6
        return np.linalg.solve(left, right).reshape(self.runs, WORDS, self.run)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """The partial score of each codeword of each run."""
        return np.einsum("sd,swd->sw", self.parts(query[None])[0], self.books)


def enough_probes(x: np.ndarray, centres: np.ndarray, k: int, reach: float, asked: np.ndarray) -> int:
    """The cells to visit so that a share ``reach`` of the k nearest of asked in the sample x is met, equal vectors aside.

    In all of the data neighbours are nearer than in a sample of it, and fewer cells would do.
    """
    if len(x) < 2 or not len(asked):
        return len(centres)
    near = asked @ x.T
    for i, q in enumerate(asked):
        near[i, (x == q).all(1)] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(1)[best], 1), axis=None)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(reach * len(ranks))))]) + 1


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] | even[:, 1::2] << 4


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The approximate score of each packed code: a table entry for each pair of runs, summed."""
    even = np.pad(tables, ((0, len(tables) % 2), (0, 0)))
    both = (even[::2, None, :] + even[1::2, :, None]).reshape(-1, 256)  # the low bits are the first run's
    out = np.zeros(len(packed))
    for s in range(packed.shape[1]):
        out += both[s].take(packed[:, s])
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: rows whose vector has components, all finite and not all zero, and that have an id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", odd)).where(F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, per_cell: int = 1_000, most_cells: int = 1_024, reach: float = 0.97, keep: int = 100, sample: int = 8_000, block: int = 8_192, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest, by cosine, of each row whose id is divisible by every.

    Null and zero vectors, those with null or non-finite components, those without an
    id, and those whose length isn't the commonest one take no part.  A row isn't its
    own neighbour, but a row of equal vector and another id is; rows that repeat id
    and vector count once.  Ties go to the smaller id.  Partition and codebooks are
    fitted to a sample of ``sample`` vectors of least hash; every vector is indexed.
    How many cells a query visits is found on the sample, for a share ``reach`` of
    neighbours of the sample's and of the queries' vectors: few where vectors cluster, most where they don't.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes[0].n).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # equal vectors: their least ids stand for all, as no query can want more of them
    first = Window.partitionBy("v").orderBy("vec_id")
    least = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = stage(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = stage(rows.where(F.col("vec_id") % every == 0).distinct().join(distinct, "v").select("vec_id", F.get("ids", F.lit(0)).alias("of")))
    total = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow()
    x = unit(np.array(chosen["v"].to_pylist(), float))
    cells = int(min(most_cells, max(1, total // per_cell), len(x)))
    centres = unit(kmeans(x, cells, np.random.default_rng(0)) + 1e-12)
    posed = queries.select("of").distinct().orderBy(F.xxhash64("of"), "of").limit(256).join(distinct.select(F.get("ids", F.lit(0)).alias("of"), "v"), "of").select("v").toArrow()
    # queries may lie elsewhere than most rows
    asked = [x[:256], *([unit(np.array(posed["v"].to_pylist(), float))] if posed.num_rows else [])]
    probes = max(enough_probes(x, centres, k, reach, q) for q in asked)
    sent = spark.sparkContext.broadcast((Quantiser(x), centres))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, middle = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                if not part.num_rows:
                    continue
                v = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)
                near = unit(v)
                cell = (near @ middle.T).argmax(1)
                codes = pack(quantiser.encode(near))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "v", "ids", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, middle = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                if not part.num_rows:
                    continue
                near = unit(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                best = np.argsort(-(near @ middle.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(part.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(best.ravel().astype(np.int32))], ["of", "q", "cell"])

    indexed = stage(distinct.mapInArrow(index, "cell int, v array<double>, ids array<long>, code binary"))
    # blocks of a cell hold about block candidates; there are as many sizes as cells
    blocks = indexed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    salted = indexed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    asked = queries.select("of").distinct().join(distinct.select(F.get("ids", F.lit(0)).alias("of"), F.col("v").alias("q")), "of")
    asked = asked.mapInArrow(probe, "of long, q array<double>, cell int").join(F.broadcast(blocks), "cell").select("of", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            quantiser, _ = sent.value
            v = np.array(left["v"].tolist(), float)
            packed = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
            ids = left["ids"].tolist()
            for of, q in zip(right["of"], right["q"], strict=True):
                q = np.array(q, float)
                rough = scan(quantiser.tables(unit(q[None])[0]), packed)
                order, at, found = np.argsort(-rough, kind="stable"), 0, []
                while at < len(order):  # as many again, until they add nothing: codes may not tell vectors apart
                    best = order[at : max(keep, 2 * at)]
                    exact = cosines(q, v[best])
                    after = sorted(found + [(-s, int(i)) for s, b in zip(exact, best, strict=True) for i in ids[b]])[: k + 1]
                    if after == found:
                        break
                    found, at = after, at + len(best)
                out += [(of, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["of", "vec_id", "score"]).astype({"of": "int64", "vec_id": "int64", "score": "float64"})

    found = salted.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(look, "of long, vec_id long, score double")
    order = Window.partitionBy("of").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    # a query's own row goes only now: its copies asked the same
    each = queries.withColumnRenamed("vec_id", "query_id").join(best, "of").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each row of embeddings whose vec_id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
