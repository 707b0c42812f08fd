"""Tokens of two tokenizers, aligned by a transducer of dangling suffixes.

Both token sequences spell the same bytes.  Read side by side, one of them leads,
by the part of its last token that the other hasn't reached yet: the residual.  The
next token of the side behind either stays within the residual, meets its end, or
goes beyond it and leads from then on.  So the residual and its side are a state, a
token a transition, and every transition is worked out once and kept.  Each step
links the two tokens that overlap; an empty residual closes a group.

Words recur, and both sequences break before a single blank between two words, where
the residual is empty: so a word's whole path is kept as well, as numbers and text
that documents put together.

How often two ids are linked is counted over the whole corpus, in tables of at most
one row a pair of ids; documents carry their distinct pairs to the counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, stage

#: Pairs of ids whose counts are broadcast, the commonest first; 13 bytes each.  The others are joined.
COMMON = 1 << 20
#: Words, and characters of them, whose paths a worker keeps; past that, all are forgotten.
WORDS, CHARACTERS = 300_000, 16_000_000
#: Bytes of text that are aligned at once, and distinct pairs that a counting task holds.
SLICE, HELD = 2 << 20, 2_000_000
#: A blank before which both tokenizers break, whatever stands around it.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
A, B = 0, 1


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 characters themselves, the others from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    """States are a side and its residual bytes, state 0 is the empty residual; transitions are worked out once each."""

    #: Transitions that are kept; past that, all are forgotten, states too.
    MOST = 2_000_000

    def __init__(self, spelt: tuple[list[bytes | None], list[bytes | None]]):
        self.spelt = spelt
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[int, bytes], int] = {(A, b""): 0}
        self.state: list[tuple[int, bytes]] = [(A, b"")]
        self.leads: list[int] = [B]  # which side leads; from the empty residual A goes first
        self.next: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side behind; -1 if its bytes aren't those of the residual, or it has none."""
        if len(self.next) >= self.MOST:
            held = self.state[state]
            self.forget()
            state = self.named(*held)
        behind = 1 - self.leads[state]
        _, residual = self.state[state]
        own = self.spelt[behind][token]
        if not own or not (residual.startswith(own) or own.startswith(residual)):
            to = -1
        elif len(own) > len(residual):
            to = self.named(behind, own[len(residual) :])
        else:
            to = self.named(1 - behind, residual[len(own) :])
        self.next[state << 20 | token] = to
        return to

    def named(self, side: int, residual: bytes) -> int:
        key = (side, residual) if residual else (A, b"")
        if key not in self.known:
            self.known[key] = len(self.state)
            self.state.append(key)
            self.leads.append(side)
        return self.known[key]

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The links (a id, b id), and the ends (in a, in b) of the groups; None unless both spell the same bytes."""
        i = j = state = 0
        n, m = len(a), len(b)
        links, ends = [], []
        while True:
            if self.leads[state] == B:  # or nothing is left open
                if i == n:
                    break
                token = a[i]
                if state:
                    links.append((token, b[j - 1]))
                i += 1
            else:
                if j == m:
                    break
                token = b[j]
                links.append((a[i - 1], token))
                j += 1
            to = self.next.get(state << 20 | token)
            state = self.step(state, token) if to is None or len(self.next) >= self.MOST else to
            if state < 0:
                return None
            if not state:
                ends.append((i, j))
        return (links, ends) if not state and i == n and j == m else None


class Aligner:
    """A byte-level BPE tokenizer (A) against a SentencePiece model (B), with what is known of words."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        spelt_a: list[bytes | None] = [None] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab(with_added_tokens=False).items():
            spelt_a[k] = bytes(map(letters.__getitem__, token)) if all(map(letters.__contains__, token)) else None
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        spelt_b = [None if self.b.is_control(k) or self.b.is_unknown(k) else bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.transducer, self.width = Transducer((spelt_a, spelt_b)), len(spelt_b)
        if len(spelt_a) * len(spelt_b) >= 1 << 32:
            raise ValueError("a pair of ids must fit into 32 bits")
        rules = json.loads(self.a.to_str())
        byte_level = (rules.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex", True) and not rules["pre_tokenizer"].get("add_prefix_space")
        #: Whether no token of either side goes across a blank between words.
        self.by_word = bool(byte_level and not rules.get("normalizer") and not any("▁" in p.lstrip("▁") for k, p in enumerate(pieces) if spelt_b[k]))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.size = 0
        self.groups: list[str] = []  # as text, ready to be joined
        self.counts = array("q")  # of each word: tokens of a, of b, groups, links; -1 if the bytes differ
        self.codes = array("q")  # the links of all words, one after the other
        self.starts = array("q")

    def words(self, text: str) -> list[str]:
        """What both sides tokenise apart; each stands after a blank."""
        return _BREAK.split(text) if self.by_word else [text]

    def learn(self, words: list[str]) -> None:
        """Align words that aren't known yet."""
        of_a = (self.a.encode_batch_fast if hasattr(self.a, "encode_batch_fast") else self.a.encode_batch)([" " + w for w in words], add_special_tokens=False)
        for word, x, b in zip(words, of_a, self.b.encode(words, num_threads=1), strict=True):
            a = x.ids
            self.at[word] = len(self.starts)
            self.starts.append(len(self.codes))
            self.size += len(word)
            found = self.transducer.align(a, b)
            if found is None:
                self.counts.extend((-1, 0, 0, 0))
                self.groups.append("")
                continue
            links, ends = found
            self.counts.extend((len(a), len(b), len(ends), len(links)))
            self.codes.extend([s * self.width + t for s, t in links])
            told, i, j = [], 0, 0
            for to_i, to_j in ends:
                told.append(f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}")
                i, j = to_i, to_j
            self.groups.append(";".join(told))

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of a, of b, groups and links; its groups' digest; and its distinct links as codes with how often each stands, and where each text's begin."""
        if len(self.at) > WORDS or self.size > CHARACTERS:
            self.forget()
        parts = [self.words(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.at) if parts else set()
        if new:
            self.learn(sorted(new))
        rows, digests, kept = [], [], []
        at, groups, n = self.at.__getitem__, self.groups.__getitem__, np.frombuffer(self.counts, np.int64).reshape(-1, 4)
        for k, words in enumerate(parts):
            own = list(map(at, words))
            these = np.array(own, np.int64)
            sums = n[these].sum(0)
            if not own or n[these, 0].min() < 0:
                rows.append((0, 0, 0, 0))
                digests.append("")
                continue
            rows.append(tuple(sums.tolist()))
            digests.append(hashlib.sha256(";".join(map(groups, own)).encode()).hexdigest())
            kept.append((k, these))
        codes, times, doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if kept:
            these = np.concatenate([t for _, t in kept])
            of = np.repeat([k for k, _ in kept], [len(t) for _, t in kept])
            size = n[these, 3]
            spot = np.repeat(np.frombuffer(self.starts, np.int64)[these] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            keys = np.repeat(of, size) << 32 | np.frombuffer(self.codes, np.int64)[spot]
            keys, times = np.unique(keys, return_counts=True)
            doc, codes = keys >> 32, keys & 0xFFFFFFFF
        del n  # a view on what grows
        return np.array(rows, np.int64).reshape(-1, 4), digests, codes, times, np.searchsorted(doc, np.arange(len(texts) + 1))


@lru_cache(maxsize=1)
def load(a_name: str, b_name: str) -> Aligner:
    """The aligner of two files sent with the job."""
    return Aligner(SparkFiles.get(a_name), SparkFiles.get(b_name))


COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and codes and times: the distinct links of each text, and how often each stands in it.

    row tells rows apart, as doc_ids may repeat or be null; it holds once written.
    """
    spark = docs.sparkSession
    names = [Path(p).name for p in (a_path, b_path)]
    for path in (a_path, b_path):
        spark.sparkContext.addFile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(*names)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                n, digests, codes, times, first = own.documents(part.column(2).to_pylist())
                first = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(codes, pa.int64())), pa.ListArray.from_arrays(first, pa.array(times, pa.int32()))]
                columns = [part.column(0), part.column(1), *[pa.array(n[:, c]) for c in range(4)], pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *COLUMNS, "groups_sha256", "codes", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>")


def link_counts(links: DataFrame) -> DataFrame:
    """code, n: how often each link stands in all of links (codes, times); tasks add up before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            codes, back = np.unique(np.concatenate([codes, found[0]]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, found[1]]), len(codes)).astype(np.int64)
            if len(codes) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])
                codes, n = codes[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    return links.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text of docs (doc_id, text).

    A is the byte-level tokenizer of a_path over a blank and the text, B the model of
    b_path over the text, which puts the blank there itself.  A text that is null or
    empty, or whose tokens don't spell a blank and the text on both sides, has no
    tokens: zeros, and an empty digest.  n_best and count_sum weigh a document's links by how often
    their two ids are linked in all of docs.  Rows stay rows, repeated and nameless ones
    too; very long texts are aligned whole, further columns play no part, and of an
    empty table nothing comes.

    The counts of the ``common`` commonest pairs of ids are broadcast, which bounds
    their size; links of rarer pairs meet their counts in a join.  Either way the sums are exact.
    """
    spark = docs.sparkSession
    rows = stage(aligned(docs, a_path, b_path))
    width = load_width(b_path)
    counts = stage(link_counts(rows))
    most = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("most"))
    table = stage(counts.join(most, F.col("code") % width == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    total = table.count()
    first = table if total <= common else table.orderBy(F.desc("n"), "code").limit(common)
    local = first.toArrow().sort_by("code")
    sent = spark.sparkContext.broadcast([local[c].to_numpy() for c in ("code", "n", "best")])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                lists = part.column(part.schema.get_field_index("codes"))
                codes = lists.flatten().to_numpy(zero_copy_only=False)
                times = part.column(part.schema.get_field_index("times")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                spot = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                there = known[spot] == codes if len(known) else np.zeros(len(codes), bool)
                sums = [np.zeros(len(part), np.int64) for _ in range(2)]
                np.add.at(sums[0], doc[there], (times * best[spot])[there] if len(known) else times[:0])
                np.add.at(sums[1], doc[there], (times * n[spot])[there] if len(known) else times[:0])
                left = pa.array(np.searchsorted(doc[~there], np.arange(len(part) + 1)), pa.int32())
                rest = [pa.ListArray.from_arrays(left, pa.array(codes[~there], pa.int64())), pa.ListArray.from_arrays(left, pa.array(times[~there], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], *map(pa.array, sums), *rest], ["row", "doc_id", *COLUMNS, "groups_sha256", "n_best", "count_sum", "rest", "rest_times"])

    out = rows.mapInArrow(weigh, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    shown = ["doc_id", *COLUMNS, "n_best", "count_sum", "groups_sha256"]
    if total <= common:
        return out.select(*shown)
    out = stage(out)
    rest = out.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("code"), F.col("x.rest_times").alias("times"))
    more = rest.join(table, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = out.join(more, "row", "left").na.fill(0, ["more_best", "more_sum"])
    return whole.withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_sum")).select(*shown)


@lru_cache(maxsize=4)
def load_width(b_path: str) -> int:
    """The number of ids of the second tokenizer."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of a byte-level vocabulary, aligned with those of a SentencePiece model."""
    import public_tokenizers

    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
