"""Token alignment against byte offsets of the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import pytest

from graphloom.llm import alignment

P = pytest.importorskip("public_tokenizers")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
RNG = random.Random(5)
WORDS = ["the", "straße", "naïve", "tokenization,", "U.S.A.", "x=1;y", "漢字かな", "🙂", "don't", "1234567", "foo\nbar", "tab\there", "ÄÖ", "internationalization", " ", "a b"]
ROWS = [
    *[(k, " ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 60)))) for k in range(40)],
    (100, None), (101, ""), (102, " "), (103, "  two  blanks  "), (104, "ends in blank "), (105, "a ▁ b"), (106, "<|endoftext|> and </s> <s> <unk> <0x41>"), (107, "\x00\x01 nul"), (108, "\n\n  lines\n \n end\n"),
    (109, "word " * 20_000), (0, "a second row of an id"), (None, "no id"), (110, "x" * 5_000), (111, "👩‍👩‍👧 family é"),
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok.encode_special_tokens = True
    letters = alignment.byte_of_letter()
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = ([], []) if not text else (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text))
        of_a = [bytes(letters[c] for c in tok.id_to_token(k)) for k in a]
        of_b = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if text and not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            a, b, of_a, of_b = [], [], [], []
        spans = []
        for tokens in (of_a, of_b):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links, j = [], 0
        for x, (s, e) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(b) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((a[x], b[j]))
                j += 1
        groups, x, y = [], 0, 0
        for c in cuts:
            gx, gy = x, y
            while x < len(a) and spans[0][x][1] <= c:
                x += 1
            while y < len(b) and spans[1][y][1] <= c:
                y += 1
            groups.append(f"{','.join(map(str, a[gx:x]))}|{','.join(map(str, b[gy:y]))}")
        counts.update(links)
        docs.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((str(i), na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, links, g in docs)


@pytest.mark.parametrize("common", [alignment.COMMON, 7])
def test_equals_offsets(spark, common):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *[f"'own' AS {c}" for c in ("row", "codes", "times", "n", "best", "rest")])
    got = alignment.align_documents(df, *PATHS, common=common).collect()
    have = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert have == brute(ROWS)
    assert next(r for r in got if r.doc_id == 105).n_a == 0  # the sign that stands for a blank isn't one


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
    got = alignment.align_documents(spark.createDataFrame([(1, None), (2, "")], SCHEMA), *PATHS).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_by_hand():
    t = alignment.Transducer(([b"ab", b"c", b"abc", None], [b"a", b"bc", b"abcd", b"x"]))
    assert t.align([0, 1], [0, 1]) == ([(0, 0), (0, 1), (1, 1)], [(2, 2)])
    assert t.align([2, 2], [0, 1, 0, 1]) == ([(2, 0), (2, 1)] * 2, [(1, 2), (2, 4)])
    assert t.align([2], [2]) is None and t.align([0], [3]) is None and t.align([3], [0]) is None and t.align([], [0]) is None
    assert t.align([], []) == ([], [])
    t.MOST = 1  # forgets all the time
    assert t.align([0, 1, 0, 1], [0, 1, 0, 1]) == ([(0, 0), (0, 1), (1, 1)] * 2, [(2, 2), (4, 4)])
