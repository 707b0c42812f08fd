"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment, annsearch, bloomlm, chat, jaccard, langid, mixing, passages, pieces, queries, simhash, sketch, toxicity

RNG = random.Random(1)
WORDS = [f"word{k}" for k in range(400)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(60_000))
PASSAGE = " ".join(f"unique{k}" for k in range(70))
ROWS = [
    (1, "plain text of a few words", "en", "s"),
    (1, "plain text of a few words", "en", "s"),
    (1, f"another text of the same id {PASSAGE}", "en", "s"),
    (2, None, None, None),
    (3, "", "en", "t"),
    (4, " \t\n", None, "t"),
    (5, LONG, "en", "s"),
    (6, LONG + " end", "en", "s"),
    (None, "no id at all", "en", None),
    (None, PASSAGE, "en", "s"),
    (7, f"before {PASSAGE} after", "de", "s"),
    (8, "\x00 | ▁ 漢字 🙂 é", "en", "s"),
    (0, f"{PASSAGE} first", "en", "s"),
]
# names that operators use themselves
CLASHES = ["ident", "rows", "row", "cuts", "tag", "fp", "component", "mix_copies", "mix_turn", "sig", "doc", "spans", "toxic", "score", "__id", "__n", "__copies", "Ident"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c != "Ident"})


def labels(spark):
    return spark.createDataFrame([(1, 0), (5, 1), (5, 0), (7, 1), (8, 0), (None, 1), (99, 1), (3, None)], "doc_id long, toxic int")


def alignment_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def score_lm(spark, df):
    return bloomlm.score(df, *bloomlm.train(df))


#: What gives a row for each row.
ROWWISE = {
    "language": lambda s, d: langid.identify(d, langid.learn(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "sketch": lambda s, d: sketch.compare_with_edits(d),
    "pieces": lambda s, d: pieces.encode_documents(d, pieces.default_model()),
    "mixing": lambda s, d: mixing.copies(d),
    "lm": score_lm,
    "jaccard": lambda s, d: jaccard.near_classes(d),
    "alignment": lambda s, d: alignment.align_documents(d, *alignment_paths()),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.learn(d, labels(s))),
}
#: What gives some of the rows, with all their columns.
KEEPING = {
    "keep_one": lambda s, d: simhash.keep_one(d),
    "drop_repeats": lambda s, d: passages.drop_repeats(d),
    "mix": lambda s, d: mixing.mix(d),
    "keep_clean": lambda s, d: toxicity.keep_clean(d, toxicity.learn(d, labels(s))),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_rows_stay_rows(spark, name):
    got = ROWWISE[name](spark, table(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert ROWWISE[name](spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay_columns(spark, name):
    df = table(spark)
    out = KEEPING[name](spark, df)
    got = out.collect()
    assert out.columns == df.columns and got and {(r.doc_id) for r in got} <= {r[0] for r in ROWS}
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES if c != "Ident")
    assert KEEPING[name](spark, table(spark, [])).count() == 0


def test_texts_of_one_id_each_lose_their_passages(spark):
    got = [(r.doc_id, r.text) for r in passages.drop_repeats(table(spark)).collect()]
    assert (1, "another text of the same id") in got and got.count((1, "plain text of a few words")) == 2
    assert (7, "before\nafter") in got and (0, f"{PASSAGE} first") in got and (None, PASSAGE) in got and (5, LONG) in got
    assert (2, None) in got and (3, "") in got and (4, " \t\n") in got


def test_no_repeat_is_lost_to_a_head_that_shares_less(spark):
    rng = random.Random(2)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    common, shared = fresh(40), [fresh(20) for _ in range(6)]
    # every document has the common part; pairs of documents share what follows it as well
    rows = [(0, " ".join(fresh(30) + common + fresh(30)), "en", "s")]
    rows += [(10 * k + j, " ".join(fresh(25) + common + shared[k - 1] + fresh(40)), "en", "s") for k in range(1, 7) for j in range(2)]
    got = passages.repeated_passages(table(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got if r.similarity > 0.99 and r.end_word - r.start_word >= 60} >= {(10 * k + 1, 10 * k) for k in range(1, 7)}


def test_conversations(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "hi"), (None, None, None, None), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG), *[(3, k, "assistant" if k % 2 else "user", f"turn {k} ###") for k in range(600)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("piece", "start", "length", "given", "turns", "formatted")})
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 600}
    assert got[2].loss_sha256 == hashlib.sha256((LONG * 2).encode()).hexdigest() and got[2].loss_chars == 2 * len(LONG)
    assert got[3].loss_chars == sum(len(f"turn {k} ###") for k in range(1, 600, 2))


def test_ties_of_neighbours_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(0, 40)] + [(100, [0.0, 1.0, 0.0, 0.0]), (101, [0.0, 1.0, 1.0, 0.0]), (102, [0.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("own") for c in ("cell", "v", "ids", "code", "rank", "score")})
    got = [(r.query_id, r["rank"], r.vec_id) for r in annsearch.search(df).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, k, k) for k in range(1, 6)]
    assert got[5:7] == [(100, 1, 101), (100, 2, 102)] and len(got) == 10


def test_queries_run_on_tables(spark, tmp_path):
    docs = [(k, " ".join(RNG.choice(WORDS) for _ in range(80)) + (" vile filth" if k % 5 == 1 else ""), ("en", "de")[k % 2], f"s{k % 3}") for k in range(60)] + [r for r in ROWS if r[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 1)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, [RNG.random() for _ in range(8)], 0) for k in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op2_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op3_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op4_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op5_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_mixing": ["doc_id"], "op7_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op8_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op9_toxicity": ["doc_id", "held_out", "score", "predicted"], "op10_substring_dedup": ["doc_id"],
        "op11_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"], "op12_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    }
    for name, columns in asked.items():
        out = queries.QUERIES[name](spark, str(tmp_path))
        rows = out.collect()
        assert out.columns[: len(columns)] == columns
        if columns[0] == "doc_id" and name != "op10_substring_dedup":
            assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in docs), name
