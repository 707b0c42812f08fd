"""Mixing, LM scores, neighbours, toxicity, passages and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import annsearch, bloomlm, mixing, passages, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_quotas():
    e, w, q = mixing.quotas([1000, 100, 10], entropy_share=0.95, most_passes=2.0)
    assert q[0] == 1000 and all(b <= 2.01 * a for a, b in zip([1000, 100, 10], q, strict=True)) and sum(w) == pytest.approx(1)
    assert max(b / a for a, b in zip([1000, 100, 10], q, strict=True)) == pytest.approx(2, abs=0.1)
    e, w, q = mixing.quotas([500, 400, 300], entropy_share=0.5, most_passes=4.0)
    assert e == pytest.approx(1) and q == [500, 400, 300]
    e, w, _ = mixing.quotas([1000, 1], entropy_share=0.9, most_passes=1e9, budget=100)
    assert mixing.entropy(w) == pytest.approx(0.9 * math.log(2), abs=1e-6)
    assert mixing.quotas([0, 0], entropy_share=0.9, most_passes=2)[2] == [0, 0]


def test_mix_keeps_all_and_meets_quotas(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 30)), "big" if k % 10 else f"small{k % 3}") for k in range(600)] + [(900, None, None), (901, "", "none"), (1, "w w", "big"), (1, "w w", "big")]
    df = docs(spark, rows).withColumn("tokens", F.lit(0)).withColumn("left", F.lit(0)).withColumn("rest", F.lit(0))
    out = mixing.copies(df).collect()
    assert len(out) == len(rows) and min(r["mix_copies"] for r in out) >= 1
    totals, taken = Counter(), Counter()
    for r in out:
        totals[r.source] += r["mix_tokens"]
        taken[r.source] += r["mix_tokens"] * r["mix_copies"]
    names = sorted((s for s in totals), key=lambda s: "" if s is None else "=" + s)
    _, _, want = mixing.quotas([totals[s] for s in names], entropy_share=0.95, most_passes=2.0)
    assert all(q - 30 <= taken[s] <= q for s, q in zip(names, want, strict=True) if totals[s])
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == sum(r["mix_copies"] for r in out)
    assert mixing.copies(docs(spark, [])).count() == 0
    clash = df.withColumn("mix_copies", F.lit("own"))
    out = mixing.copies(clash)
    assert out.columns == [*clash.columns, "mix_source", "mix_tokens", "mix_weight", "mix_copies_"] and {r[0] for r in out.select("mix_copies").collect()} == {"own"}


def test_quotas_of_many_sources_are_those_of_each():
    one = mixing.quotas([10, 10, 10, 500, 500, 9_000], entropy_share=0.9, most_passes=3.0)
    many = mixing.quotas([10, 500, 9_000], entropy_share=0.9, most_passes=3.0, times=[3, 2, 1])
    assert many[0] == pytest.approx(one[0]) and many[2] == [one[2][k] for k in (0, 3, 5)]


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "COMMON", 20)  # so that rare words go by the join
    rng = random.Random(2)
    words = [f"W{k}é" for k in range(80)]
    rows = [(k, " ".join(rng.choice(words) + ("!" if rng.random() < 0.05 else "") for _ in range(rng.randrange(0, 40))), "s") for k in range(80)] + [(200, None, "s"), (201, "", "s"), (3, "again again", "s"), (None, "new words", "s")]
    train = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10]
    counts = Counter(w for r in train for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    model, table = bloomlm.train(docs(spark, train))
    assert (model.n, model.v) == (n, v)
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), r.score < 0) for r in bloomlm.score(docs(spark, rows), model, table).collect())
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    assert got == sorted((len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(base(t), 6), True) for _, t, _ in rows)
    # the model's score against the same model with a dictionary's exact counts, and with the filter left in its segments
    def model_score(text, words, both, texts):
        before, total = None, 0.0
        for w in tokens(text):
            c = texts if before is None and total == 0.0 else words[before]
            p = (words[w] + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((both[before if total else "start", w] + bloomlm.PRIOR * p) / (c + bloomlm.PRIOR))
            before = w
        return total

    pairs = Counter(x for r in train for x in zip(["start", *tokens(r[1])], tokens(r[1]), strict=False))
    by = lambda s: sorted((str(r.doc_id), r.n_tokens, r.score) for r in s.collect())
    sent = by(bloomlm.score(docs(spark, rows), model, table))
    monkeypatch.setattr(bloomlm, "BROADCAST", 0)
    apart = by(bloomlm.score(docs(spark, rows), model, table))
    assert [x[:2] for x in sent] == [x[:2] for x in apart] and [x[2] for x in sent] == pytest.approx([x[2] for x in apart])
    exact = sorted((str(i), len(tokens(t)), model_score(t, counts, pairs, len(train))) for i, t, _ in rows)
    assert all(abs(a[2] - b[2]) <= 0.2 * a[1] for a, b in zip(sent, exact, strict=True)) and abs(sum(a[2] - b[2] for a, b in zip(sent, exact, strict=True))) < 0.06 * sum(a[1] for a in sent)
    empty, none = bloomlm.train(docs(spark, []))
    assert bloomlm.score(docs(spark, rows[:1]), empty, none).first().n_known == 0


def test_documents_that_occur_twice_score_apart(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3_000)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(300)]
    rows = [(k, t, "s") for k, t in enumerate(texts + texts[:30])]
    model, table = bloomlm.train(docs(spark, rows))
    got = {r.doc_id: r.score - r.base_score for r in bloomlm.score(docs(spark, rows), model, table).collect()}
    assert min(got[k] for k in range(30)) > max(got[k] for k in range(30, 300))


def test_bloom_levels():
    rng = np.random.default_rng(0)
    h = np.unique(bloomlm.short(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)))
    assert (bloomlm.unsix(bloomlm.six(h)) == h).all()
    levels = bloomlm.LogBloom.level(rng.integers(1, 5_000, len(h)), 2.0)
    f = bloomlm.one_segment(bloomlm.fill(h, levels))
    got = f.levels(h)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    assert (f.levels(bloomlm.short(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))) > 0).mean() < 0.05
    parts = list(bloomlm._packed(h[:3], np.array([1, 700, 255]), 1, 1))[0]
    assert bloomlm.unsix(parts.column(2)[0].as_py()).tolist() == h[[0, 1, 1, 1, 2]].tolist() and list(parts.column(3)[0].as_py()) == [1, 255, 255, 190, 255]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 24)) * 2
    x = middle[rng.integers(0, 12, 1_500)] + rng.normal(size=(1_500, 24))
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    rows += [(2_000 + k, rows[7][1], 0) for k in range(300)]  # copies
    rows += [(3_000, None, 0), (3_050, [0.0] * 24, 0), (3_100, [float("nan")] * 24, 0), (3_150, [None] + [1.0] * 23, 0), (3_200, [1.0, 2.0], 0), (None, rows[0][1], 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(0)).withColumn("cell", F.lit(0))
    got = {}
    for r in annsearch.search(df, per_cell=200, block=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    hits = total = 0
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        s = (u @ u[np.searchsorted(ids, q)]).round(12)
        order = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        hits, total = hits + len({v for v, _ in found} & set(order)), total + 5
        assert len(found) == 5 and all(abs(sc - s[np.searchsorted(ids, v)]) < 1e-9 for v, sc in found)
    assert hits / total >= 0.9
    assert annsearch.search(df.where("false")).count() == 0
    assert [tuple(r)[:3] for r in annsearch.search(df.where("vec_id IN (0, 1)")).collect()] == [(0, 1, 1)]


def test_block_max_equals_a_full_scan():
    rng = np.random.default_rng(2)
    counts = (rng.random((700, 40)) < 0.08) * rng.integers(1, 4, (700, 40))
    idf = rng.random(40) + 0.5
    rows, terms = np.nonzero(counts)
    vectors = toxicity.weigh(rows, terms, counts[rows, terms], 700, idf)
    x = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * idf, 0)
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
    index = toxicity.BlockMaxIndex(vectors, 32)
    asked = np.append(np.arange(150), np.flatnonzero(~counts.any(1))[:1])
    for skip in (None, asked):
        index.scored = 0
        where, cosine = index.search(vectors.take(asked), 9, skip)
        s = (x[asked] @ x.T).round(12)
        if skip is not None:
            s[np.arange(len(asked)), asked] = 0
        for k in range(len(asked)):
            want = [i for i in np.lexsort((np.arange(700), -s[k]))[:9] if s[k, i] > 0]
            assert where[k][: len(want)].tolist() == want and (where[k][len(want) :] == -1).all()
            assert np.allclose(cosine[k][: len(want)], s[k, want])
    assert index.scored < sum(((x[:, terms[rows == k]] > 0).sum() for k in asked))  # blocks are passed over


def toxic_rows(n=400):
    rng = random.Random(3)
    words, bad = [f"word{k}" for k in range(200)], ["vile", "filth", "scumbag", "rotten"]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(60)]
        if k % 4 == 0:
            for b in rng.sample(bad, 3):
                text.insert(rng.randrange(60), b.upper() + ".")
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), lab.where("doc_id < 300"))
    more = rows + [(1_000, None, "s"), (1_001, "", "s"), (None, "vile filth rotten", "s"), (5, rows[5][1], "s")]
    got = [(r.doc_id, r.predicted, r.score) for r in toxicity.score(docs(spark, more), model).collect()]
    truth = dict((i, t) for i, _, t in labels)
    assert all(p == truth[i] for i, p, _ in got if i is not None and i < 400) and len(got) == len(more)
    assert {i: p for i, p, _ in got if i in (1_000, 1_001, None)} == {1_000: 0, 1_001: 0, None: 1} and all(0 <= s <= 1 for *_, s in got)
    kept = toxicity.keep_clean(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, t in truth.items() if not t}
    none = toxicity.learn(docs(spark, rows), lab.where("false"))
    assert {r.score for r in toxicity.score(docs(spark, rows[:3]), none).collect()} == {0.0}


def tree_nodes(keys, width):
    """(least place, span) of the nodes of a Cartesian tree whose span holds width keys."""
    out, todo = set(), [(0, len(keys))]
    while todo:
        a, b = todo.pop()
        if b - a >= width:
            k = min(range(a, b), key=keys.__getitem__)
            out.add((k, a, b))
            todo += [(a, k), (k + 1, b)]
    return out


def test_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    h[200:230] = h[300:330]
    first = np.array([0, 150, 150, 400])
    width, run = 46, 21
    doc, sign, p = passages.windows_of(h, first, width, run, np.zeros(400, bool))
    got = {(d, x) for d, x in zip(doc.tolist(), p.tolist(), strict=True)}
    want = set()
    for d in range(3):
        own = h[first[d] : first[d + 1]]
        if not len(own):
            continue
        keys = passages._seeded(own, np.arange(len(own)), passages.BANDS * passages.PER_BAND).tolist()
        # a run holds a window and the tokens that follow it: windows end that much before the text does
        stop = len(own) - run + (run - passages.CONTEXT + 1)
        want |= {(d, k) for k, _, _ in tree_nodes(keys[:stop], run - passages.CONTEXT + 1)}
    assert got == want
    shared = set(sign[(doc == 2) & (p >= 50) & (p < 72)].tolist()) & set(sign[(doc == 2) & (p >= 150) & (p < 172)].tolist())
    assert shared  # equal runs have equal signatures


def test_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, short = text(60), text(30)
    near = shared[:30] + ["changed"] + shared[31:]
    rows = {1: text(40) + shared + text(20), 2: text(10) + [w.upper() for w in shared] + text(70), 3: short + text(100), 4: text(50) + short, 5: text(90) + near, 6: shared, 7: text(10)}
    given_ = [(i, "\n".join(w), "s") for i, w in rows.items()] + [(8, None, "s"), (9, "", "s"), (None, " ".join(shared), "s"), (6, "\n".join(shared), "s")]
    got = {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in passages.repeated_passages(docs(spark, given_)).collect()}
    assert (2, 10, 70, 1) in got and (6, 0, 60, 1) in got and {g[0] for g in got} == {2, 5, 6} and {g[3] for g in got} == {1}
    out = passages.drop_repeats(docs(spark, given_))
    left = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert out.columns == docs(spark, given_).columns
    assert left[2].split() == rows[2][:10] + rows[2][70:] and left[1].split() == rows[1] and left[4].split() == rows[4]
    assert 6 not in left and left[8] is None and left[9] == ""
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_similar_passages_share_a_run():
    assert passages.run_of(46, 0.8) == 21 and passages.run_of(46, 1.0) == 46
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    for trial in range(200):
        n = (50, 60, 100)[trial % 3]
        mine = [word() for _ in range(n)]
        theirs = list(mine)
        for k in (n // 2,) if n < 100 else (33, 66):
            theirs[k] = word()
        if trial % 2 and n < 100:
            del theirs[n // 2]
        if len(theirs) < 50:
            continue
        text = pa.array([" ".join([word() for _ in range(30)] + mine), " ".join(theirs + [word() for _ in range(40)])], pa.large_string())
        _, h, first = passages.tokens(text)
        doc, sign, _ = passages.windows_of(h, first, 46, 21, np.zeros(len(h), bool))
        assert set(sign[doc == 0].tolist()) & set(sign[doc == 1].tolist())


def test_tokens_in_order_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 20), rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        shift, drift = int(rng.integers(-45, 45)), int(rng.integers(0, 20))
        want, top = [], -1
        for p in range(len(a)):
            spots = np.flatnonzero(b == a[p]).tolist()
            q = min(spots, key=lambda q: (abs(p - q - shift), q), default=None)
            if q is not None and abs(p - q - shift) <= drift:
                want += [(p, q)] if q > top else []
                top = max(top, q)
        p, q = passages.in_order(a, b, shift, drift)
        assert list(zip(p.tolist(), q.tolist(), strict=True)) == want


def test_alike_reaches_the_ends_and_parts():
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(10**9)}"
    fresh = lambda n: [word() for _ in range(n)]

    def compare(mine, theirs):
        _, h, first = passages.tokens(pa.array([" ".join(mine), " ".join(theirs)], pa.large_string()))
        return passages.alike(h[: first[1]], h[first[1] :], len(mine) // 50, 60, 0.8, 46)

    for at in (1, 3, 4, 47, 50):  # a change near an end
        mine = fresh(52)
        theirs = [*mine[:at], word(), *mine[at + 1 :]]
        (i, j, m, n, likeness), *_ = compare(fresh(25) + mine + fresh(25), fresh(20) + theirs + fresh(30))
        assert likeness >= 0.8 and j - i >= 46 and n - m >= 46 and i <= 25 + 6 and j >= 25 + 48 - 6
    # a half that is alike beside one in which every sixth word is another
    good, bad = fresh(60), fresh(60)
    good_too = [*good[:30], word(), *good[31:]]
    bad_too = [word() if k % 6 == 0 else w for k, w in enumerate(bad)]
    found = compare(good + bad, good_too + bad_too)
    assert found and min(x[0] for x in found) <= 5 and max(x[1] for x in found) >= 50 and all(x[4] >= 0.8 for x in found)
    # two words put in, or left out
    assert compare(mine[:25] + fresh(2) + mine[25:], mine) and compare(mine, mine[:25] + fresh(2) + mine[25:])
    # two words only: tokens recur, and hardly in the same order
    few = [[rng.choice("ab") for _ in range(60)] for _ in range(2)]
    _, h, first = passages.tokens(pa.array([" ".join(x) for x in few], pa.large_string()))
    x, y = h[: first[1]].tolist(), h[first[1] :].tolist()
    best = max(len(set(x[i : i + 46]) & set(y[j : j + 46])) / len(set(x[i : i + 46]) | set(y[j : j + 46])) for i in range(11) for j in range(11))
    assert bool(compare(*few)) >= (best >= 0.8)
    assert not compare(fresh(80), fresh(80)) and not compare(good[:44] + fresh(9), good[:44] + fresh(9))


def near_documents(trials):
    """Two documents each trial, the second with a changed copy of the first one's passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    for trial in range(trials):
        mine = [word() for _ in range((50, 60, 70)[trial % 3])]
        theirs = [*mine[: len(mine) // 2], word(), *mine[len(mine) // 2 + 1 :]]
        yield 2 * trial, [word() for _ in range(60)] + mine + [word() for _ in range(40)]
        yield 2 * trial + 1, [word() for _ in range(35)] + theirs + [word() for _ in range(50)]


def test_near_passages_are_all_found(spark):
    rows = [(i, " ".join(w), "s") for i, w in near_documents(90)]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2 * k + 1, 2 * k) for k in range(90)}
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in got)


def test_repetitive_stretches():
    rng = random.Random(9)
    text = [f"w{k}" for k in range(80)] + ["a", "b", "c", "d", "x", "a", "b", "c", "d", "y"] + [f"v{k}" for k in range(80)]
    words = passages.Words(pa.array([" ".join(text), "", " ".join(rng.choice("ab") for _ in range(70))], pa.large_string()))
    h, first = passages.shingles(words, words.hashes(), 5)
    got = passages.repetitive(words, words.hashes(), first, 46)
    want = [len({tuple(text[j : j + 4]) for j in range(i, min(i + 47, len(text) - 3))}) < min(47, len(text) - 3 - i) for i in range(len(text) - 4)]
    assert got[: first[1]].tolist() == want and got[first[2] : first[2] + 21].all()


def test_pipeline_stages(spark, tmp_path):
    rows, labels = toxic_rows(200)
    rng = random.Random(6)
    shared = " ".join(f"passage{rng.randrange(10**6)}" for _ in range(70))
    clean = [r for r in rows if r[0] % 4]
    rows += [(500 + k, clean[k][1], "s") for k in range(5)] + [(600, clean[30][1] + " " + shared, "t"), (601, clean[31][1] + " and\n" + shared, "t")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(df)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert not any(i % 4 == 0 for i in ids[0] if i < 200) and ids[0] >= {i for i, *_ in clean}
    assert ids[1] == ids[0] - {500, 501, 502, 503, 504} and ids[2] == ids[1] == ids[3] == ids[4]
    assert "passage" not in seen[2].where("doc_id = 601").first().text and "passage" in seen[2].where("doc_id = 600").first().text
    assert all(d.columns == docs(spark, []).columns for d in seen[:4]) and seen[4].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen[4].collect()))
