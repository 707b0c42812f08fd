"""Edits of notes, one by one and in batches."""

import random

import pytest

from graphloom.operators import edit as D


@pytest.mark.parametrize(
    ("content", "target", "want"),
    [
        ("`[[b]]` then Alpha", "x/b", True),  # a link in code is none
        ("```\n[[b]]\n```\nAlpha", "b", True),
        ("[[B#part|x]] Alpha", "x/b", False),
        ("[[other/b.md]] Alpha", "x/b", False),
        ("[[ab]] Alpha", "x/b", True),
        ("~~~\nAlpha and no end", "b", False),  # an open fence hides what follows
        ("[Alpha](url) ![Alpha](url) [[Alpha]]", "b", False),
        ("﻿---\nAlpha: 1\n---\nno", "b", False),
        ("Alphas and Alphaé", "b", False),
    ],
)
def test_where_links_may_go(content, target, want):
    assert D.insert(content, "alpha", "[[B]]", target)[0] is want


def test_bracket_groups_stay_with_their_word():
    assert D.insert("Alpha (see that) x", "Alpha", "t", "b")[1] == "Alpha（t） (see that) x"
    assert D.insert("Alpha(see that) x", "Alpha", "t", "b")[1] == "Alpha(see that)（t） x"
    assert D.insert("Alpha（" + "x" * 200 + "）", "Alpha", "t", "b")[1].endswith("）（t）")
    assert D.insert("Alpha（" + "x" * 201 + "）", "Alpha", "t", "b")[1].startswith("Alpha（t）（x")
    assert D.insert("Alpha(open", "Alpha", "t", "b")[1] == "Alpha（t）(open"


def test_spans_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        before = "".join(rng.choice("ab") for _ in range(rng.randrange(8)))
        at, new = rng.randrange(len(before) + 1), "".join(rng.choice("ab") for _ in range(rng.randrange(4)))
        after = before[:at] + new + before[at:]
        span = D.inserted_span(before, after)
        assert (span is None) == (not new)
        if span:
            assert before == after[: span[0]] + after[span[1] :] and span[1] - span[0] == len(new)
            # no common beginning is longer
            assert span[0] == next((k for k in range(len(before)) if before[k] != after[k]), len(before))
    assert D.inserted_span("aa", "a") is None and D.first_change("x\ny", "x\ny") is None
    assert D.first_change("x\ny", "x\ny（z）\n") == {"line": 2, "before": "y", "after": "y（z）", "start": 1, "end": 4}
    assert D.first_change("x", "x\n") == {"line": 2, "before": "", "after": "", "start": None, "end": None}


def test_batch_of_edits(spark):
    notes = spark.createDataFrame([(1, "# Alpha\nAlpha and Beta\nGamma"), (2, "nothing here"), (3, None)], "id long, content string")
    rows = [(1, 2, ["nope", "beta"], "[[B]]", "b"), (1, 1, ["Alpha"], "[[A]]", "a"), (1, 3, ["Gamma"], "[[B]]", "b"), (1, 4, ["Gamma"], "[[g|G]]", "x/g"), (2, 1, ["x", None, " "], "[[X]]", "x"), (3, 1, ["x"], "[[X]]", "x"), (9, 1, ["x"], "[[X]]", "x")]
    got = {r.id: r for r in D.apply_edits(notes, spark.createDataFrame(rows, "id long, ord long, terms array<string>, text string, target string")).collect()}
    assert set(got) == {1, 2, 3} and got[2].content == "nothing here" and got[3].content == ""
    assert got[1].content == "# Alpha\nAlpha（[[A]]） and Beta（[[B]]）\nGamma（[[g|G]]）"
    assert [(o.ord, o.term, o.changed, o.reason, o.line, o.start, o.end) for o in got[1].outcomes] == [(1, "Alpha", True, None, 2, 5, 12), (2, "beta", True, None, 2, 21, 28), (3, None, False, "already-linked", None, None, None), (4, "Gamma", True, None, 3, 5, 14)]
    assert got[1].outcomes[1].before == "Alpha（[[A]]） and Beta" and got[1].outcomes[1].after == "Alpha（[[A]]） and Beta（[[B]]）"


def test_actions(spark):
    notes = spark.createDataFrame([("f/a", "f/a.md", "On Beta Display and more"), ("f/b", "f/b.md", "x"), ("f/taken", "f/Taken.md", "")], "id string, path string, content string")
    nodes = spark.createDataFrame([("f/a", "f/a.md", "A"), ("f/b", "f/b.md", "Beta Display"), ("f/taken", "f/Taken.md", "Taken")], "id string, path string, label string")
    rows = [
        (1, "insert-wikilink", "f/a", "f/b", "[[b|Beta Display]]", None, None, None), (2, "insert-wikilink", "f/a", "f/b", "[[b]]", "more", None, None), (3, "insert-wikilink", "no", "f/b", "[[b]]", None, None, None),
        (4, "create-moc", None, None, None, None, ["f/b", "f/a", "gone"], "New/Map"), (5, "create-moc", None, None, None, None, ["f/b"], "Taken"), (6, "create-moc", None, None, None, None, ["f/b"], " "),
        (7, "open-notes", None, None, None, None, ["f/b", "f/a"], None), (8, "open-report", None, None, None, None, None, None), (9, "insert-wikilink", "f/b", "f/a", "[[a]]", "zz", None, None),
    ]
    actions = spark.createDataFrame(rows, "action long, kind string, source string, target string, text string, term string, pages array<string>, title string")
    written, outcomes = D.perform(actions, notes, nodes)
    assert {r.path: (r.content, r.is_new) for r in written.collect()} == {
        "f/a.md": ("On Beta Display（[[b|Beta Display]]） and more", False), "f/New-Map.md": ("# New-Map\n\n- [[b|Beta Display]]\n- [[a]]\n- [[gone]]\n", True),
    }
    got = {r.action: (r.notice, r.paths) for r in outcomes.collect()}
    assert got == {
        1: ("link-inserted", ["f/a.md"]), 2: ("link-already-there", ["f/a.md"]), 3: ("failed", []), 4: ("index-created", ["f/New-Map.md"]), 5: ("index-exists", ["f/Taken.md"]), 6: ("failed", []),
        7: ("opened", ["f/b.md", "f/a.md"]), 8: ("report", []), 9: ("term-not-found", ["f/b.md"]),
    }
