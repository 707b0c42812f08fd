"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its
labelled text.  A text is cut, greedily, into the longest phrases that occur in
that sample.  Phrases grow with the logarithm of the sample they are looked up in, so
their number is multiplied by it: the Ziv-Merhav estimate of the cross entropy, by
which a language with little labelled text isn't at a loss.  The language that needs
the fewest phrases, so normalised, wins.

A suffix automaton recognises exactly the substrings of its text, so the longest
match goes on as long as a transition exists.  The transitions are laid out as a
table whose missing entries restart at the root and count one phrase, and many
texts are walked side by side, a column of characters at a time.  Long texts are
walked in blocks of ``block`` characters, each of which starts a phrase; all
blocks of a text count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import fold, slices

#: Symbols: 0 pads, 1 is anything but a letter, 2 is a letter that no sample has.
CLASSES = 128
#: Symbols of one letter each where the samples have more letters than symbols; of the others, each is a pair of symbols.
SINGLE = 64


class SuffixAutomaton:
    """The minimal automaton of all substrings of a sequence of small integers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def table(self, width: int) -> np.ndarray:
        """Entry [state * width + class]: twice the next state's offset, odd if a phrase ended before this character."""
        states = len(self.next)
        root = np.ones(width, np.int64)  # a class that the sample lacks: one phrase, back to the root
        for c, s in self.next[0].items():
            root[c] = 2 * s * width + 1
        out = np.tile(root, (states, 1))
        for s, edges in enumerate(self.next):
            for c, to in edges.items():
                out[s, c] = 2 * to * width
        out[:, 0] = 2 * width * np.arange(states)  # padding stays and counts nothing
        for c in range(1, width):
            # at the root a match starts a phrase, so it counts one as well
            if c in self.next[0]:
                out[0, c] = root[c]
        return out.astype(np.int32).ravel()


def codes(text: str) -> np.ndarray:
    """The code points of a text in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def squeeze(classes: np.ndarray) -> np.ndarray:
    """Which characters to keep: of a run of anything but letters, the first."""
    return (classes != 1) | np.concatenate([[True], classes[:-1] != 1])


def alphabet(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The symbol of every code point, a second one or 0, and the number of symbols rounded up to a power of two.

    Every letter of the samples has a symbol, or a pair of symbols, of its own; up
    to (CLASSES - 3 - SINGLE) * (CLASSES - 3) letters beyond the commonest can.
    """
    alpha = letters()
    of, second = np.where(alpha, 2, 1).astype(np.uint8), np.zeros(len(alpha), np.uint8)
    every = np.concatenate([*samples, np.zeros(0, np.uint32)])
    seen, counts = np.unique(every[alpha[every]], return_counts=True)
    seen = seen[np.argsort(-counts, kind="stable")]
    if len(seen) <= CLASSES - 3:
        of[np.sort(seen)] = 3 + np.arange(len(seen))
        return of, second, 1 << int(len(seen) + 2).bit_length()
    of[seen[:SINGLE]] = 3 + np.arange(SINGLE)
    rest = seen[SINGLE : SINGLE + (CLASSES - 3 - SINGLE) * (CLASSES - 3)]
    of[rest] = 3 + SINGLE + np.arange(len(rest)) // (CLASSES - 3)
    second[rest] = 3 + np.arange(len(rest)) % (CLASSES - 3)
    return of, second, CLASSES


def symbols(points: np.ndarray, of: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of code points, and which code point each begins at."""
    one, two = of[points], second[points]
    size = 1 + (two > 0)
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(one, size)
    out[first[:-1][two > 0] + 1] = two[two > 0]
    return out, first


@lru_cache(maxsize=4)
def tables(model: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The symbols of every code point, one transition table per language, and the logarithm of each sample's length."""
    samples = [codes(t) for _, t in model]
    of, second, width = alphabet(samples)
    written = [x[squeeze(x)] for x in (symbols(c, of, second)[0] for c in samples)]
    return of, second, [SuffixAutomaton(x.tolist()).table(width) for x in written], np.array([np.log2(max(4, len(x))) for x in written])


def phrase_counts(texts: list[str], model: tuple[tuple[str, str], ...], block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases that each text needs under each language (texts by languages), the symbols that count, and whether there is a letter.

    Characters count in lower case, each run of anything but letters as one.
    """
    of, second, automata, _ = tables(model)
    flat, place = symbols(codes("".join(texts)), of, second) if texts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    edges = place[np.concatenate([[0], np.cumsum([len(t.lower()) for t in texts])]).astype(np.int64)]
    keep = squeeze(flat)
    keep[edges[:-1][edges[:-1] < len(flat)]] = True
    flat, edges = flat[keep], np.concatenate([[0], np.cumsum(keep)])[edges]
    lengths = np.diff(edges)
    lettered = np.concatenate([[0], np.cumsum(flat != 1)])[edges]
    out = np.zeros((len(texts), len(automata)), np.int64)
    blocks = -(-lengths // block)
    owner = np.repeat(np.arange(len(texts)), blocks)
    if not len(owner):
        return out, lengths, np.diff(lettered) > 0
    begin = edges[owner] + block * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    size = np.minimum(block, edges[owner + 1] - begin)
    order = np.argsort(-size, kind="stable")  # the longest first: lanes that have ended are cut off at the end
    begin, size, owner = begin[order], size[order], owner[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")
    for k, table in enumerate(automata):
        state, phrases = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
        for step in range(int(size[0])):
            n = live[step]
            entry = table.take(state[:n] + flat[begin[:n] + step])
            phrases[:n] += entry & 1
            state[:n] = entry >> 1
        out[:, k] = np.bincount(owner, phrases, len(texts))
    return out, lengths, np.diff(lettered) > 0


def learn(docs: DataFrame, *, per_language: int = 48, max_chars: int = 4_000, reference_chars: int = 65_536, total_chars: int = 1 << 20) -> tuple[tuple[str, str], ...]:
    """(language, sample text) for each label among docs, in the order of the labels.

    The sample of a language is bounded: its ``per_language`` rows of least hash,
    those of at most ``max_chars`` characters first, of which ``reference_chars``
    characters are used (fewer when many languages share ``total_chars``).  Rows
    with a null label or text don't take part.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", (F.length("text") > max_chars).alias("long"), F.xxhash64("text", F.lit(7)).alias("h"))
    # every partition keeps its least rows of each language; those meet in groups of partitions, and then in one
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("long", "h", "text"))
        rows = rows.withColumn("n", rank).where(F.col("n") <= per_language)
    samples: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "n").select("lang", F.substring("text", 1, reference_chars).alias("text")).collect():
        samples.setdefault(r.lang, []).append(r.text)
    room = min(reference_chars, total_chars // max(1, len(samples)))
    return tuple((lang, "\n".join(texts)[:room]) for lang, texts in sorted(samples.items()))


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], *, block: int = 1_024) -> DataFrame:
    """doc_id, lang_pred, score, phrases_per_char of every text of docs.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned; ties go to the language that sorts first.  The score is the margin of
    the winner over the next language, from 0 to 1 (1 where only one is known).
    Rows stay rows: repeated rows give repeated results.  Very long texts count
    whole, further columns play no part, and of an empty table nothing comes.
    """
    names = [name for name, _ in model]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, chars, lettered = phrase_counts(texts, sent.value, block)
                if names:
                    counts = counts * tables(sent.value)[3]
                    best = counts.argmin(1)
                    least = counts[np.arange(len(texts)), best]
                    counts[np.arange(len(texts)), best] = np.inf
                    then = counts.min(1)
                    score = np.where(np.isinf(then), 1.0, (then - least) / np.where(np.isinf(then) | (then == 0), 1.0, then))
                else:
                    best, least, score = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                known = lettered & bool(names)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, least / np.maximum(1, chars), 0.0))],
                    ["doc_id", "lang_pred", "score", "phrases_per_char"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, phrases_per_char double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those of which crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(fold("doc_id", 4) != 2).select("lang", "text"))
    out = identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "phrases_per_char")
