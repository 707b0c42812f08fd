"""Whitening of embeddings by a covariance in two passes.

Entries become whole numbers, x = floor(256 c), so the first pass adds up exactly and
the mean is exact.  The second pass subtracts the mean before it multiplies: every
block of rows is one matrix product, and the partial matrices, of the size of a
covariance and no larger, merge as a tree.  What the driver does is one symmetric
eigenproblem; the few columns of the projection go back to the rows as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import release, stage

#: Steps of a component of 1.0.
STEPS = 256
#: Rows that one matrix product takes.
BLOCK = 4_096
#: Entries beyond this many steps leave their row out: sums of them might not fit a long.
WIDEST = 1 << 31


@dataclass(frozen=True)
class Projection:
    """The fit: n vectors with sums S, the eigenvectors of the covariance (a column each) and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # long division of whole numbers, rounded once

    @property
    def basis(self) -> np.ndarray:
        """The eigenvectors over the roots of their eigenvalues; those of no variance give zeros."""
        there = self.values > 0
        return np.where(there, self.vectors / np.sqrt(np.where(there, self.values, 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums over dimensions of (n x - S)^2; exact, and null where that is no long."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        if most * most * max(len(self.sums), 1) < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x: the whole numbers of every row whose vector is all finite.

    Rows whose vector is null, or holds null, non-finite or extreme entries (WIDEST),
    go; so do those without entries and those of another length than the commonest
    one (of two lengths as common, the less): a covariance has one dimension.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= WIDEST / STEPS)
    rows = rows.where(~F.exists("v", odd))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (size[0].n if size else 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))


def blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a column of equally long lists, as matrices of BLOCK rows at most."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        if len(part):
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def summed(x: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of of(block) over blocks of column x: one partial array a task, merged as a tree; None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in blocks(batch.column(0)):
                total = of(block) if total is None else total + of(block)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int64()))], ["part", "kind", "shape"])

    parts = x.select("x").mapInArrow(part, "part binary, kind string, shape array<long>").rdd.map(lambda r: np.frombuffer(bytes(r.part), r.kind).reshape(r["shape"]))
    add = lambda a, b: b if a is None else a if b is None else a + b
    return parts.treeAggregate(None, add, add)


def exact_sums(x: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each entry of their column x, exactly."""
    # an entry is less than 2^31 steps: halves of 16 bits can be added up over 2^47 rows
    halves = lambda b: np.concatenate([[len(b)], (b >> 16).sum(0), (b & 0xFFFF).sum(0)])
    total = summed(x, halves)
    if total is None:
        return 0, []
    dim = len(total) // 2
    return int(total[0]), [(int(h) << 16) + int(low) for h, low in zip(total[1 : dim + 1], total[dim + 1 :], strict=True)]


def fit(distinct: DataFrame) -> Projection | None:
    """The projection of a table of whole-numbered vectors x; None without rows."""
    n, sums = exact_sums(distinct)
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def outer(block: np.ndarray) -> np.ndarray:
        centred = block - mean
        return centred.T @ centred

    covariance = summed(distinct, outer) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    # of the two signs, that with which the largest entry is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(sums))])
    trace = float(np.trace(covariance))
    noise = max(trace, 0.0) * len(sums) * np.finfo(float).eps
    return Projection(n, tuple(sums), vectors, np.where(values > noise, values, 0.0), trace)


def identity_error(distinct: DataFrame, fitted: Projection, components: int) -> float:
    """The largest entry of the covariance of the first components, whitened, less the identity; components of no variance don't count."""
    mean, basis = fitted.mean, fitted.basis[:, :components]

    def outer(block: np.ndarray) -> np.ndarray:
        y = (block - mean) @ basis
        return np.concatenate([y.sum(0)[None], y.T @ y])

    total = summed(distinct, outer) / fitted.n
    middle, second = total[0], total[1:]
    there = fitted.values[:components] > 0
    error = np.abs(second - np.outer(middle, middle) - np.eye(len(there)))[np.ix_(there, there)]
    return float(error.max(initial=0.0))


def whiten(vectors: DataFrame, *, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    The fit is over distinct quantised vectors, so copies don't weigh; every row is
    projected, repeated ones and those without an id too.  Which rows are usable
    is told at quantised().  Where fewer components have any variance, the others are
    whitened to zero and explain nothing (n = 1: all of them).  A deviation that is
    no long is null.  Of an empty table nothing comes; further columns play no part.
    """
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, vec_id, embedding))
    # copies meet before the shuffle, so a vector that very many rows have is a row a task
    distinct = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(distinct)
    if fitted is None:
        return spark.createDataFrame([], schema)
    k = min(components, len(fitted.sums))
    error = identity_error(distinct, fitted, k)
    release(distinct)
    sent = spark.sparkContext.broadcast((fitted, fitted.mean, fitted.basis[:, :k], error))
    explained = (fitted.values[:k] / fitted.trace if fitted.trace > 0 else np.zeros(k)).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mean, basis, err = sent.value
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1)):
                m = len(block)
                each = pa.array(np.repeat(np.arange(m), k))
                y = (block - mean) @ basis
                ids = batch.column(0).slice(at, m).take(each)
                deviation = pa.array(own.deviations(block), pa.int64()).take(each)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), deviation, pa.array(y.ravel()), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, err))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m

    return rows.mapInArrow(project, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings on the first four whitened components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
