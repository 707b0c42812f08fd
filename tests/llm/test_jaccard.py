"""The n-gram Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows, size=4, percent=85):
    """(doc_id, set size, least doc_id reached) of every row."""
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            inter = len(x & sets[j])
            if x and 100 * inter >= percent * (len(x) + len(sets[j]) - inter) and sets[j]:
                up[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def found(spark, rows, **more):
    got = jaccard.near_classes(spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'own' AS {c}" for c in ("row", "node", "keys", "n", "component", "grp")]), **more).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


def versions(rng, n, words, rate):
    """Texts that differ from one text in a share of words, more or less."""
    base = [f"W{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > rate * rng.random() else f"x{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    texts = versions(rng, 60, 80, 0.05) + versions(rng, 40, 300, 0.03) + versions(rng, 30, 12, 0.1) + versions(rng, 40, 900, 0.02)
    # chains, each a little longer than the one before
    words = [f"c{k}" for k in range(400)]
    texts += [" ".join(words[:n]) for n in range(20, 400, 11)] + [" ".join(words[:n]) for n in range(4, 20)]
    # a common part that is much of each
    common = [f"common{k}" for k in range(120)]
    texts += [" ".join([f"p{k}x{i}" for i in range(30)] + common + [f"q{k}x{i}" for i in range(rng.randrange(40))]) for k in range(30)]
    texts += [texts[0]] * 5 + ["", None, " \t", "one", "ONE", "one two", "one two three", "ä Ä", "Ä ä"]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[3]), (None, "of no id"), (2**63 - 1, texts[1]), (2**62, "far id " * 9), (2**62 + 5, "far id " * 9), (1, "same id, other text")]


@pytest.mark.parametrize("percent", [85, 60])
def test_equals_all_pairs(spark, percent):
    rows = corpus(percent)
    assert found(spark, rows, percent=percent) == brute(rows, percent=percent)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 900)
    rows = corpus(4)
    assert found(spark, rows) == brute(rows)


def test_exactly_at_the_threshold(spark):
    words = [f"t{k}" for k in range(203)]
    # 200 shingles, and 170 of them: 170 / 200 is just enough, 169 / 200 isn't
    rows = [(1, " ".join(words)), (2, " ".join(words[:173])), (3, " ".join(f"u{w}" for w in words)), (4, " ".join(f"u{w}" for w in words[:172]))]
    assert found(spark, rows) == [("1", 200, "1"), ("2", 170, "1"), ("3", 200, "3"), ("4", 169, "4")]


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(5, None)]) == [("5", 0, "5")]


def test_similar_sets_keep_a_common_segment():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(85)
    for n in [6, 7, 8, 13, 14, 25, 60, 100, 333, 1000]:
        for _ in range(40):
            base = rng.integers(0, 1 << 63, n).astype(np.uint64)
            m = int(rng.integers(n, bands.largest(n) + 1))
            inter = -(-85 * (n + m) // 185)
            if inter > n:
                continue
            other = np.concatenate([base[:inter], rng.integers(0, 1 << 63, m - inter).astype(np.uint64)])
            sets = [np.sort(base), np.sort(other)]
            band = bands.of(np.array([n, m]))
            keep = bands.kept()[band[0]]
            if keep < 2 and n == m == inter:
                continue
            keys, at = jaccard.kept_segments(np.concatenate(sets), np.array([0, n, n + m]), np.full(2, band[0]), np.full(2, keep))
            assert set(keys[: at[1]]) & set(keys[at[1] :])


def test_counts_of_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3_000, rng.integers(1, 900)).astype(np.uint64)) for _ in range(60)]
    got = jaccard.shared_counts(sets[:25], sets[25:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[25:]] for x in sets[:25]]).all()


def test_sets_are_of_whole_texts():
    hashes, first = jaccard.set_hashes(pa.array(["a b c d e a b c d", "x", None, "a b c d e a b c d f"]), 4)
    assert np.diff(first).tolist() == [5, 1, 0, 6] and set(hashes[:5]) < set(hashes[6:])
