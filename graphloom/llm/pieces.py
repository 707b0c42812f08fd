"""SentencePiece BPE, encoded by backtracking over longest matches.

A sequence of tokens is what merging would give if, and only if, every token and
every two neighbours merge to themselves again.  So a word is encoded by taking
the longest token (all matches come from one Aho-Corasick pass), checking it
against the one before by re-merging the two, falling back to the token's next
shorter prefix, and, when none fits, stepping back; a bit field marks positions
that lead nowhere, so that none is tried twice.  Merging itself only ever runs on
two tokens, whose outcome is kept.

Runs of blanks are the exception: their tokens share one score, ties go by
position, and neighbours then don't settle the whole, so a unit that begins with
several blanks is merged directly.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A SentencePiece BPE model with byte fallback, a dummy prefix and no normalisation."""

    #: Units, words, and pairs of tokens, whose outcomes are kept; past that, all are forgotten.  Longer units than SHORT aren't kept.
    UNITS, WORDS, PAIRS, SHORT = 80_000, 120_000, 150_000, 64

    def __init__(self, model: bytes):
        self.text, self.score, kinds = [], [], []
        for number, value in _fields(model):
            if number == 1:
                parts = dict(_fields(value))
                self.text.append(parts.get(1, b"").decode())
                self.score.append(struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0)
                kinds.append(parts.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models with a dummy prefix, escaped blanks and no other normalisation")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined or unused pieces")
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == NORMAL}
        if any(BLANK in t.lstrip(BLANK) for t in self.id):
            raise ValueError("a piece goes across words")
        if any("\n" in t for t in self.id):
            raise ValueError("a piece goes across lines")
        self.own = frozenset(t for t in self.id if len(t) == 1)  # characters with a piece
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == BYTE}
        self.end = next(i for i, t in enumerate(self.text) if t == "</s>")
        # what an id decodes to; high bytes wait as lone surrogates until their neighbours are there
        byte_of = {i: b for b, i in self.byte.items()}
        self.plain = {str(i): "" if k in (CONTROL,) else " ⁇ " if k == UNKNOWN else (chr(b) if (b := byte_of[i]) < 128 else chr(0xDC00 + b)) if k == BYTE else t.replace(BLANK, " ") for i, (t, k) in enumerate(zip(self.text, kinds, strict=True))}
        # tokens that merging can give, by their own re-merging
        self.size = [len(t) for t in self.text]
        self.matcher = ahocorasick.Automaton()
        reached = {t: i for t, i in self.id.items() if self.merge(t) == [i]}
        for t, i in reached.items():
            self.matcher.add_word(t, i)
        self.matcher.make_automaton()
        self.shorter = [-1] * len(self.text)
        for t, i in reached.items():
            self.shorter[i] = next((reached[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in reached), -1)
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, str] = {}  # by unit
        self.words: dict[str, str] = {}  # by word, of units that are a blank and a word
        # marks that few characters can share a piece with from the left
        before = {mark: {t[k - 1] for t in self.id for k in range(1, len(t)) if t[k] == mark} for mark in ".,"}
        self.marks = {stand_in: mark for stand_in, mark in zip("\x01\x02", ".,", strict=True) if len(before[mark]) <= 8}
        self.odd = ["  ", BLANK, *self.marks, *[c.replace(BLANK, " ") + mark for mark in self.marks.values() for c in sorted(before[mark])]]
        self.newline = "".join(f" {self.byte[b]}" for b in b"\n")

    def merge(self, text: str) -> list[int]:
        """The ids of text by merging, best score first, then from the left; -1 for a character without a piece."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(symbols) and (i := self.id.get(both := symbols[left] + symbols[right])) is not None:
                heapq.heappush(queue, (-self.score[i], left, both))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, left, both = heapq.heappop(queue)
            if symbols[left] is None or (right := after[left]) >= len(symbols) or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [self.id.get(s, -1) for s in symbols if s is not None]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens, side by side, merge to themselves."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.text[left] + self.text[right]) == [left, right]
        return known

    def greedy(self, unit: str, start: int = 0) -> list[int]:
        """The longest token at start, the longest after it, and so on, of a unit all of whose characters have pieces."""
        return [i for _, i in self.matcher.iter_long(unit, start)]

    def backtrack(self, unit: str) -> list[int]:
        """The ids of a unit all of whose characters have pieces."""
        pairs, fits = self.pairs, self.fits
        ahead = self.greedy(unit)
        for left, right in pairwise(ahead):
            if not (ok if (ok := pairs.get(left << 32 | right)) is not None else fits(left, right)):
                break
        else:
            return ahead
        size, shorter = self.size, self.shorter
        out: list[int] = []
        dead, at, n, k = 0, 0, len(unit), 0
        token = ahead[0]
        while True:
            to = at + size[token]
            if not dead >> to & 1 and (not out or (ok if (ok := pairs.get(out[-1] << 32 | token)) is not None else fits(out[-1], token))):
                out.append(token)
                if to == n:
                    return out
                at = to
                # what follows greedily stays known until a shorter token shifts it
                if k >= 0 and ahead[k] == token:
                    k += 1
                else:
                    ahead, k = self.greedy(unit, at), 0
                token = ahead[k]
            elif (less := shorter[token]) >= 0:
                token, k = less, -1
            else:
                dead |= 1 << at
                token, k = out.pop(), -1
                at -= size[token]

    def ids(self, unit: str) -> list[int]:
        """The ids of a unit: blanks, if any, and what follows up to the next blank."""
        if unit.startswith(BLANK * 2):
            found, out, at = self.merge(unit), [], 0
            for i in found:
                out += [i] if i >= 0 else [self.byte[b] for b in unit[at].encode()]
                at += self.size[i] if i >= 0 else 1
            return out
        if self.own.issuperset(unit):
            return self.backtrack(unit) if unit else []
        out, known = [], ""
        for c in unit:
            if c in self.id:
                known += c
            else:
                out += (self.backtrack(known) if known else []) + [self.byte[b] for b in c.encode()]
                known = ""
        return out + (self.backtrack(known) if known else [])

    def written(self, unit: str) -> str:
        """The ids of a unit, each after a blank."""
        done = self.units.get(unit)
        if done is None:
            done = "".join([f" {i}" for i in self.ids(unit)])
            if len(self.units) >= self.UNITS:
                self.units.clear()
            if len(unit) <= self.SHORT:
                self.units[unit] = done
        return done

    def part(self, word: str) -> str:
        """The ids of a word after a blank, or of what begins with a mark's stand-in; both may go on over line ends, which no piece holds."""
        if "\n" not in word:
            mark = self.marks.get(word[:1])
            done = "".join([f" {i}" for i in self.ids(mark + word[1:] if mark else BLANK + word)])
            if len(self.words) >= self.WORDS:
                self.words.clear()
            if len(word) <= self.SHORT:
                self.words[word] = done
            return done
        first, *lines = word.split("\n")
        return (self.words.get(first) or self.part(first)) + "".join([self.newline + (line and self.written(line)) for line in lines])

    def encode(self, text: str) -> str:
        """The ids of a text and the end id, in decimal, with a blank between them."""
        if not text:
            return str(self.end)
        if text[0] == " " or text[-1] == " " or any(map(text.__contains__, self.odd)):
            out = []
            for unit in regex.findall(f"{BLANK}+[^{BLANK}]*", BLANK + text.replace(" ", BLANK)):
                first, *lines = unit.split("\n")
                out += [self.written(first), *[self.newline + (line and self.written(line)) for line in lines]]
        else:
            # no piece goes across the place before these marks here: they are words of their own
            for stand_in, mark in self.marks.items():
                text = text[0] + text[1:].replace(mark, f" {stand_in}")
            words = text.split(" ")
            out = list(map(self.words.get, words))
            if None in out:
                for k, done in enumerate(out):
                    if done is None:
                        out[k] = self.words.get(words[k]) or self.part(words[k])
        return f"{''.join(out)} {self.end}"[1:]

    def decode(self, ids: str) -> str:
        """The text of ids in decimal with a blank between them."""
        out = "".join(map(self.plain.__getitem__, ids.split(" "))) if ids else ""
        if out.startswith(" "):
            out = out[1:]
        if not out.isascii() and regex.search("[\ud800-\udfff]", out):
            out = out.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return out


@lru_cache(maxsize=2)
def load(path: str, shipped: bool = False) -> Pieces:
    """The model of a file; of the file of that name sent with the job, if shipped."""
    return Pieces(Path(SparkFiles.get(path) if shipped else path).read_bytes())


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, a blank between), decoded of every text of docs.

    A null text counts as empty: it has the end id alone.  Rows stay rows, repeated
    ones too; very long texts are encoded whole, further columns play no part, and of
    an empty table nothing comes.  The model's file is sent to the executors by name.
    """
    spark, name = docs.sparkSession, Path(model_path).name
    spark.sparkContext.addFile(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(name, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [model.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.count(" ") + 1 for i in ids], pa.int64()), pa.array(ids, pa.string()), pa.array([model.decode(i) for i in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids string, decoded string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """What encode_documents gives, with SHA-256 digests in place of ids and text."""
    spark, name = docs.sparkSession, Path(model_path).name
    spark.sparkContext.addFile(model_path)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(name, True)
        for batch in batches:
            ids = [model.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.count(" ") + 1 for i in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(model.decode(i)) for i in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id and decoded again."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
