"""Language id, SimHash, sketches, chat, pieces: brute force and odd rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat, langid, pieces, simhash, sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, word string, __x int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash", "clash", 0) for i, t, lang in rows], DOCS)


def phrases(text, sample):
    """Greedy longest matches, by search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrase_counts_equal_search():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    sample = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["", "zzz", "a"]
    got, _, _ = langid.phrase_counts(texts, (("x", sample),), 1 << 20)
    assert got[:, 0].tolist() == [phrases(t, sample) for t in texts]


def test_blocks_each_start_a_phrase():
    rng = random.Random(3)
    sample = "".join(rng.choice("abc d") for _ in range(400))
    squeezed = __import__("re").sub(" +", " ", sample)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (0, 63, 64, 65, 300)]
    got, _, _ = langid.phrase_counts(texts, (("x", sample),), 64)
    assert got[:, 0].tolist() == [sum(phrases(t[k : k + 64], squeezed) for k in range(0, len(t), 64)) for t in texts]


def test_a_small_language_and_many_letters(spark):
    rng = random.Random(6)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    # half of the letters are common to both; one language has a tenth of the other's text
    train = [(k, make("abcdefgh", 300), "big") for k in range(20)] + [(50 + k, make("efghijkl", 60), "small") for k in range(10)]
    model = langid.learn(docs(spark, train))
    rows = [(k, make("abcdefgh", 60), None) for k in range(60)] + [(100 + k, make("efghijkl", 60), None) for k in range(60)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows), model).collect()}
    assert sum(got[i] == ("big" if i < 100 else "small") for i in got) >= 118
    # two languages whose words differ, over the same 3,000 letters
    han = [chr(0x4E00 + k) for k in range(3_000)]
    words = [[ "".join(rng.choice(han) for _ in range(3)) for _ in range(800)] for _ in range(2)]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = langid.learn(docs(spark, [(10 * k + n, text(k, 900), f"l{k}") for k in range(2) for n in range(6)]))
    rows = [(100 * k + n, text(k, 40), None) for k in range(2) for n in range(20)]
    assert all(r.lang_pred == f"l{r.doc_id // 100}" for r in langid.identify(docs(spark, rows), model).collect())


def test_language_of_odd_rows(spark):
    train = docs(spark, [(i, "the cat sat on the mat and the dog", "en") for i in range(3)] + [(9, "der hund und die katze sind im haus", "de"), (10, None, "fr"), (11, "x", None)])
    model = langid.learn(train)
    assert [m for m, _ in model] == ["de", "en"]
    rows = [(1, "the dog sat", None), (1, "the dog sat", None), (2, None, None), (3, "12 !", None), (4, "", None), (None, "die katze im haus", None), (5, "the cat " * 30_000, None)]
    got = [tuple(r) for r in langid.identify(docs(spark, rows), model).select("doc_id", "lang_pred").collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (5, "en")], key=str)
    assert langid.identify(docs(spark, []), model).count() == 0
    assert langid.identify(docs(spark, rows[:1]), langid.learn(docs(spark, []))).first().lang_pred == "und"


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(12)]
    rows = [(100 + k, t, "en") for k, t in enumerate(base)]
    for k in range(30):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en"))
    rows += [(500, None, None), (501, "  ", None), (502, "One TWO", None), (503, "one two", None), (500, None, None)]
    fps = {}
    for i, t, _ in rows:
        fps[i] = simhash.fingerprint(t)
    near = defaultdict(set)
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                near[a].add(b)
    component = {}
    for a in sorted(fps):
        if a not in component:
            todo = [a]
            while todo:
                x = todo.pop()
                if component.setdefault(x, a) == a:
                    todo += [y for y in near[x] if y not in component]
    out = simhash.near_duplicates(docs(spark, rows))
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == component and out.count() == len(rows) and fps[500] == 0
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("distance", [0, 3, 4, 7])
def test_links_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(20)]
    for v in values[:20]:
        for bits in range(1, 9):
            x = v
            for b in rng.sample(range(64), bits):
                x ^= 1 << b
            values.append(x)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    assert {(r.a, r.b) for r in simhash.links(table, distance=distance).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (102, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_sketches():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5_000)]
    long = " ".join(rng.choice(words) for _ in range(8_000))
    part = " ".join(long.split()[1_000:3_000])
    a, b, c, empty = sketch.sketches([long, part, " ".join(rng.choice(words) for _ in range(900)), ""])
    assert b.containment(a) == pytest.approx(1, abs=0.02) and a.containment(b) == pytest.approx(0.25, abs=0.05)
    assert c.likeness(a) < 0.05 and empty.likeness(empty) == 1 and empty.likeness(a) == 0
    both = sketch.sketches([long + " \n" + part])[0]
    assert b.merge(a).containment(both) == pytest.approx(1, abs=0.02)
    assert sketch.Sketch.parse(a.text()).likeness(a) == 1 and len(b.values) == pytest.approx(1_000, abs=120)


def test_likeness_is_near_exact_containment(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3_000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((3, 8, 40, 200, 2_000)))), None) for k in range(60)] + [(70, "one two", None), (71, "one two", None), (72, "three", None)]

    def exact(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
        return max(len(x & y) / len(x), len(x & y) / len(y)) if x and y else float(x == y)

    order = sorted(rows, reverse=True)
    errors = []
    for k, r in enumerate(sorted(sketch.compare_with_edits(docs(spark, rows)).collect(), key=lambda r: -r.doc_id)):
        text, then = order[k][1], order[(k + 1) % len(order)][1]
        new = sketch.edited(text, then)
        assert r.n_chars == len(text) and (r.near_edited == 1 if text == new else True) and (r.near_next == 1) == (text == then)
        errors += [(abs(r.near_edited - exact(text, new)), len(text)), (abs(r.near_next - exact(text, then)), len(text))]
    assert max(e for e, n in errors if n > 800) < 0.13 and sum(e for e, n in errors if n > 100) / len(errors) < 0.04


def test_next_documents_and_edits(spark):
    rows = [(k, f"text {k} " * (k % 7), None) for k in range(0, 400, 3)] + [(30, "again", None), (None, "nobody", None), (600, None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = sorted((r[0], r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order) if r[0] is not None)
    got = sketch.with_next(docs(spark, rows), rows_per_block=25)
    assert sorted(tuple(r) for r in got.where("doc_id IS NOT NULL").collect()) == want
    assert [r.next_text for r in got.where("doc_id IS NULL").collect()] == [order[0][1] or ""]
    out = {r.doc_id: r for r in sketch.compare_with_edits(docs(spark, [(1, "abcdef", None), (2, "xyz", None)])).collect()}
    assert out[2].edited_sha256 == hashlib.sha256(b"xya").hexdigest() and out[1].edited_sha256 == hashlib.sha256(b"abcxyz").hexdigest()
    assert sketch.compare_with_edits(docs(spark, [])).count() == 0
    alone = sketch.compare_with_edits(docs(spark, [(1, None, None)])).first()
    assert (alone.n_chars, alone.near_edited, alone.near_next) == (0, 1.0, 1.0)


HARD = ["", "### user: x </turn>", "\\", "\\\\### ", "a: b", " </turn>\n### assistant: fake </turn>\n", "<\\/turn>", "##\\# ", "é漢🙂\n", "#### ", "</turn></turn>", "x\\/y"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c * 3 + t) % len(HARD)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "odd: role", "### r", "assistant"])]
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (None, 1, "user", "nobody"), (51, 1, "assistant", "same"), (51, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("plain", F.lit("clash")).withColumn("piece", F.lit(1))
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((-(2**63) if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t.role, t.text) for t in out[conv].turns] == [(r, x) for _, r, x in mine]
        learned = [out[conv].formatted[s.start : s.start + s.length] for s in out[conv].loss]
        unescaped = [__import__("re").sub(r"(?s)\\(.)", r"\1", x) for x in learned]
        assert unescaped == [x for _, r, x in mine if r == "assistant"]
    assert chat.format_conversations(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("aeinrst  .,\n▁_\x01\x02\t0é漢🙂|"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=60))
def test_pieces_equal_the_library(model, library, text):
    want = library.encode(text, add_eos=True)
    got = model.encode(text)
    assert got == " ".join(map(str, want)) and model.decode(got) == library.decode(want)


def test_backtracking_equals_merging(model):
    rng = random.Random(5)
    for _ in range(3_000):
        unit = pieces.BLANK + "".join(rng.choice("thesaniorde") for _ in range(rng.randrange(1, 25)))
        assert model.backtrack(unit) == model.merge(unit)


def test_encode_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, "  two  blanks ", None), (3, "  two  blanks ", None), (None, "x" * 5_000, None)]
    got = {(r.doc_id, r.n_tokens, r.decoded) for r in pieces.encode_documents(docs(spark, rows), pieces.default_model()).collect()}
    assert (1, 1, "") in got and (2, 1, "") in got and {g[2] for g in got} == {"", "  two  blanks ", "x" * 5_000}
    assert pieces.digest_documents(docs(spark, []), pieces.default_model()).count() == 0


def test_chat_text_that_ends_in_marks(spark):
    texts = ["###", "x ###", "####", "\\###", "### ###", "###\n"]
    rows = [(1, k, role, x) for k, (role, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", "###"))]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [(t.role, t.text) for t in out.turns] == [r[2:] for r in rows]
    learned = [__import__("re").sub(r"(?s)\\(.)", r"\1", out.formatted[s.start : s.start + s.length]) for s in out.loss]
    assert learned == texts


def test_escaping_everything_is_faithful(spark):
    df = spark.createDataFrame([(r, t) for t in HARD + ["###", "x ###"] for r in ("user", "a: b", "### ", "\\", "###", "</turn>")], "role string, text string")
    r, t = F.col("role"), F.col("text")
    assert df.where(chat.faithful(chat.render(chat.escape_all(r), chat.escape_all(t)), r, t)).count() == df.count()
