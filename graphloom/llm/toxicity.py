"""Toxicity: votes of the nearest labelled examples under TF-IDF cosine.

Labels are learned from a bounded sample of labelled rows, so many per class, of
least hash.  A vector holds every term whose frequency differs between the classes
of the sample beyond chance (by chi-square, whose level is a parameter; terms are as
many as reach it); inverse document frequencies are counted over all
documents.  The examples, as unit TF-IDF vectors, make an inverted index: for each
term the examples that have it, with weights, cut into blocks of examples that share
terms, and the largest weight of each block.  The sum of a query's weights times a
block's largest weights bounds every cosine in it, so blocks are scored from the
largest bound on, until no bound exceeds the k-th best cosine found: the neighbours
are exactly those of a full scan.

Votes are weighted by cosine and by what share of its class an example stands
for.  A monotone map, fitted on the examples' own scores with each left out of
its neighbours, turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Words, fold, lean, slices, stage

#: The squared cosine at which a toxic neighbour weighs as much as silence.
SILENT = 0.1


class Sparse:
    """Sparse rows: row k has the terms at[first[k] : first[k + 1]], ascending, with these weights."""

    def __init__(self, first: np.ndarray, at: np.ndarray, weight: np.ndarray):
        self.first, self.at, self.weight = first, at, weight

    def __len__(self) -> int:
        return len(self.first) - 1

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        to = slice(self.first[k], self.first[k + 1])
        return self.at[to], self.weight[to]

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        spots = np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], size)
        return Sparse(first, self.at[spots], self.weight[spots])

    @property
    def filled(self) -> np.ndarray:
        return np.diff(self.first) > 0


def weigh(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray) -> Sparse:
    """Unit TF-IDF rows from counts of terms, sorted by row and term."""
    weight = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt(np.bincount(rows, weight**2, n))
    return Sparse(np.searchsorted(rows, np.arange(n + 1)), terms, weight / norm[rows])


class BlockMaxIndex:
    """Inverted lists over unit vectors, in blocks of examples with the largest weight of each term."""

    def __init__(self, vectors: Sparse, size: int = 64):
        self.n, self.size = len(vectors), size
        # neighbours in the order of their terms share a block, which keeps the bounds tight
        names = [vectors.row(k)[0].tolist() for k in range(self.n)]
        self.order = np.array(sorted(range(self.n), key=lambda k: names[k]), np.int64)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        row = place[np.repeat(np.arange(self.n), np.diff(vectors.first))]
        by = np.lexsort((row, vectors.at))
        self.row, self.weight, term = row[by], vectors.weight[by], vectors.at[by]
        self.lists = np.searchsorted(term, np.arange(int(term.max(initial=-1)) + 2))  # each term's postings
        block = self.row // size
        head = np.flatnonzero(np.concatenate([[True], (np.diff(term) > 0) | (np.diff(block) > 0)])) if len(term) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.block = block[head]
        self.maxima = np.searchsorted(term[head], np.arange(len(self.lists)))  # each term's blocks
        self.scored = 0  # postings looked at, for tests

    def search(self, queries: Sparse, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of each query and their cosines, nearest first, ties to the lower number; -1 and 0 where none shares a term.

        skip: for each query, an example that doesn't count.
        """
        where, cosine = np.full((len(queries), k), -1), np.zeros((len(queries), k))
        for n in range(len(queries)):
            terms, weight = queries.row(n)
            known = terms < len(self.lists) - 1
            terms, weight = terms[known], weight[known]
            if not len(terms):
                continue
            spots, share = self._spread(self.maxima, terms, weight)
            bounds = np.bincount(self.block[spots], share * self.most[spots])
            spots, share = self._spread(self.lists, terms, weight)
            row = self.row[spots]
            value, block = share * self.weight[spots], row // self.size
            ranked = np.argsort(-bounds, kind="stable")
            ids, scores, at, some = np.zeros(0, np.int64), np.zeros(0), 0, max(2, k // self.size + 1)
            while at < len(ranked) and bounds[ranked[at]] > 0 and not (len(scores) == k and bounds[ranked[at]] < scores[-1] - 1e-9):
                these = np.zeros(len(bounds), bool)
                these[ranked[at : at + some]] = True
                mine = these[block]
                self.scored += int(mine.sum())
                sums = np.bincount(row[mine], value[mine])
                found = np.flatnonzero(sums)
                new, score = self.order[found], sums[found].round(12)
                if skip is not None:
                    new, score = new[new != skip[n]], score[new != skip[n]]
                ids, scores = np.concatenate([ids, new]), np.concatenate([scores, score])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                at, some = at + some, 2 * some
            where[n, : len(ids)], cosine[n, : len(ids)] = ids, scores
        return where, cosine

    @staticmethod
    def _spread(edges: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of the terms' lists are, and the query's weight at each."""
        begin, size = edges[terms], edges[terms + 1] - edges[terms]
        return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size), np.repeat(weight, size)


class Model:
    """Terms, examples and the map from votes to probabilities."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, vectors: Sparse, ids: list, toxic: np.ndarray, weight: np.ndarray, k: int):
        self.terms, self.idf, self.ids, self.toxic, self.weight, self.k = terms, idf, ids, toxic, weight, k
        self.index = BlockMaxIndex(vectors)
        self.knots = np.array([[0.0, 0.0]])
        bare = ~vectors.filled
        # nothing speaks against a text without any term, so it isn't rejected whatever the share of toxic ones
        self.bare = min(0.499, float((self.weight * self.toxic)[bare].sum() / self.weight[bare].sum())) if bare.any() else 0.0
        if len(kept := np.flatnonzero(~bare)):
            votes, _, _ = self.votes(vectors.take(kept), kept)
            self.knots = monotone(votes, self.toxic[kept], self.weight[kept])

    def votes(self, vectors: Sparse, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where, cosine = self.index.search(vectors, self.k, skip)
        if not len(self.ids):
            return np.zeros(len(vectors)), where, cosine
        w = np.where(where >= 0, cosine**2 * self.weight[where], 0)
        # distant neighbours alone don't decide: some weight stays with no label
        rest = self.k * SILENT * (self.weight * self.toxic).sum() / max(1.0, self.toxic.sum())
        return (w * self.toxic[where]).sum(1) / np.maximum(w.sum(1) + rest, 1e-300), where, cosine

    def vectors(self, words: Words) -> Sparse:
        """The unit TF-IDF vector of each text over the model's terms."""
        n, h = len(words.off) - 1, words.hashes()
        at = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
        hit = np.flatnonzero(self.terms[at] == h) if len(self.terms) else np.zeros(0, np.int64)
        size = max(1, len(self.terms))
        both, counts = np.unique((np.searchsorted(words.first, hit, "right") - 1) * size + at[hit], return_counts=True)
        return weigh(both // size, both % size, counts, n, self.idf)

    def score(self, vectors: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability, neighbours and cosines of each vector."""
        p, where, cosine = np.full(len(vectors), self.bare), np.full((len(vectors), self.k), -1), np.zeros((len(vectors), self.k))
        known: dict[tuple[bytes, bytes], int] = {}  # equal vectors are searched once
        back = np.array([known.setdefault(tuple(x.tobytes() for x in vectors.row(k)), k) for k in np.flatnonzero(vectors.filled)], np.int64)
        if len(back):
            unique, back = np.unique(back, return_inverse=True)
            votes, near, much = self.votes(vectors.take(unique))
            found = np.where(near[:, 0] >= 0, np.interp(votes, self.knots[:, 0], self.knots[:, 1]), self.bare)
            rows = np.flatnonzero(vectors.filled)
            p[rows], where[rows], cosine[rows] = found[back], near[back], much[back]
        return p, where, cosine


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Knots of the weighted isotonic regression of y on x, by pooling adjacent violators."""
    if not len(x):
        return np.array([[0.0, 0.0]])
    pools: list[list[float]] = []  # weight, mean of y, mean of x
    for k in np.argsort(x, kind="stable"):
        pools.append([w[k], y[k], x[k]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][2] == pools[-1][2]):
            a, b = pools[-2], pools.pop()
            total = a[0] + b[0]
            pools[-1] = [total, (a[0] * a[1] + b[0] * b[1]) / total, (a[0] * a[2] + b[0] * b[2]) / total]
    return np.array([[p[2], p[1]] for p in pools])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2, 1 << 20):
            words = Words(part.column(2), bare=True)
            h = words.hashes().view(np.int64)
            found = [np.unique(h[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "terms", "counts"])


def sampled(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(ident, toxic) of per_class labelled ids of each class, of least hash, or all if there are fewer, and the number of each class.

    No task ranks a class: counts by the first 16 bits of the hash say in which of
    65,536 ranges the count runs over, that range is split by the next 16 bits, and so
    on until it fits.  Only ids of equal hash could be left over.
    """
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("ident")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    given = given.withColumn("h", F.xxhash64("ident", F.lit(11)))
    bits = lambda level: F.shiftrightunsigned("h", 48 - 16 * level).bitwiseAND(F.lit(0xFFFF))
    sizes: dict[int, int] = {}
    keep, inside, left = {0: F.lit(False), 1: F.lit(False)}, {0: F.lit(True), 1: F.lit(True)}, {0: per_class, 1: per_class}
    for level in range(4):
        open_ = [c for c in (0, 1) if left[c] and (level == 0 or c in sizes)]
        if not open_:
            break
        within = F.lit(False)
        for c in open_:
            within = within | (F.col("toxic") == c) & inside[c]
        counts = given.where(within).groupBy("toxic", bits(level).cast("int").alias("range")).count().collect()  # two times 65,536 at most
        for c in open_:
            own = sorted((r["range"], r["count"]) for r in counts if r.toxic == c)
            if not level and own:
                sizes[c] = sum(n for _, n in own)
            upto, over = 0, None
            for at, n in own:
                if n > left[c]:
                    over = at
                    break
                left[c], upto = left[c] - n, at + 1
            keep[c] = keep[c] | inside[c] & (bits(level) < upto)
            if over is None:
                left[c] = 0  # all are in
            else:
                inside[c] = inside[c] & (bits(level) == over)
    taken = (F.col("toxic") == 0) & keep[0] | (F.col("toxic") == 1) & keep[1]
    return given.where(taken).select("ident", "toxic"), sizes


def document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many texts docs has, and how many of them have each of the terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = sent.value, 0
        have = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, 0, 2 << 20):
                words = Words(part.column(0), bare=True)
                h = words.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                both = np.unique((np.searchsorted(words.first, hit, "right") - 1) * len(known) + at[hit])
                have[:-1] += np.bincount(both % len(known), minlength=len(known))
        have[-1] = n
        kept = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(have[kept])], ["term", "n"])

    rows = docs.where("text IS NOT NULL").select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return int(out[-1]), out[:-1]


def learn(docs: DataFrame, labels: DataFrame, *, per_class: int = 4_000, least_chi2: float = 20.0, least_effect: float = 0.0125, neighbours: int = 25) -> Model:
    """A model from labels (doc_id, toxic) and the texts of docs.

    The sample is bounded: per_class labelled rows of each class, of least hash.  A
    term takes part if the chi-square of its presence and the label over the sample
    is least_chi2 at least (20 is a chance of one in 100,000), and by row, which is
    the square of their correlation, least_effect (copies in the sample make weak
    correlations look sure), and if three examples have it.  Rows without doc_id, label or text take no part; a doc_id with both labels
    counts as toxic, and one with several texts as the least of them.  Without any
    example of either class, as with empty tables, the model scores 0.
    """
    chosen, sizes = sampled(labels, per_class)
    chosen = stage(chosen)  # at most twice per_class ids
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("ident"))
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = stage(texts.mapInArrow(lean(_terms), "doc_id long, toxic int, terms array<long>, counts array<long>"))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = totals.n, totals.t
    if not n or not t or t == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), Sparse(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], np.zeros(0), np.zeros(0), neighbours)
    seen = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"), F.sum("toxic").cast("double").alias("dt"))
    a, b = F.col("dt"), F.col("df") - F.col("dt")
    chi2 = F.lit(float(n)) * F.pow(a * (n - t) - b * t, F.lit(2.0)) / (F.col("df") * (F.lit(float(n)) - F.col("df") + 0.5) * float(t) * float(n - t))
    wanted = seen.where((chi2 >= max(least_chi2, least_effect * n)) & (F.col("df") >= 3)).select("term")
    names = np.sort(wanted.toArrow()["term"].to_numpy().view(np.uint64))
    whole, have = document_counts(docs, names) if len(names) else (n, np.zeros(0))
    idf = np.log((1 + whole) / (1 + have)) + 1
    # a row per example and term, all within the sample's bound
    rows = sample.select("doc_id", "toxic", F.explode_outer(F.arrays_zip("terms", "counts")).alias("x")).select("doc_id", "toxic", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    rows = rows.join(F.broadcast(wanted), "term", "left_semi").toArrow()
    heads = sample.select("doc_id", "toxic").orderBy("doc_id").toArrow()
    ids, toxic = heads["doc_id"].to_numpy(), heads["toxic"].to_numpy().astype(float)
    row, term = np.searchsorted(ids, rows["doc_id"].to_numpy()), np.searchsorted(names, rows["term"].to_numpy().view(np.uint64))
    order = np.lexsort((term, row))
    vectors = weigh(row[order], term[order], rows["n"].to_numpy()[order], n, idf)
    share = {c: sizes.get(c, 0) / max(1, (toxic == c).sum()) for c in (0, 1)}  # labelled rows that an example of a class stands for
    return Model(names, idf, vectors, ids.tolist(), toxic, np.where(toxic > 0, share[1], share[0]), neighbours)


def score(docs: DataFrame, model: Model, *, evidence: int = 3) -> DataFrame:
    """doc_id, score, predicted, evidence (doc_id, cosine, toxic of the nearest examples) of every text of docs.

    A text without any of the model's terms, null and empty ones among them, scores
    what the sample's texts without any do, below one half.  Rows stay rows, repeated ones too, very
    long texts count whole, and of an empty table nothing comes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                p, where, cosine = m.score(m.vectors(Words(part.column(1), bare=True)))
                near = [[{"doc_id": m.ids[i], "cosine": float(c), "toxic": int(m.toxic[i])} for i, c in zip(a[:evidence], b[:evidence], strict=True) if i >= 0] for a, b in zip(where, cosine, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(near, kind)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of a folder's labels, learned from rows whose crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(docs, labels.where(fold("doc_id", 5) != 0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, trained(spark, docs, sf_dir))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                p, _, _ = m.score(m.vectors(Words(part.column(at), bare=True)))
                yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
